"""Collocations against plain counting of every phrase in Python, and the query against its SQL."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from goldseam.llm import collocations as co
from goldseam.llm.queries import ORACLE_SQL, QUERIES
from helpers import awkward, empty

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(docs, least, top=co.TOP):
    """The contract word for word; ``docs`` are (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts[lang, tuple(ws[i : i + k])] += 1
    good = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    around = Counter()
    for (lang, p), a in good.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                around[lang, p[i : i + size]] = max(a, around[lang, p[i : i + size]])
    out = []
    for lang in totals:
        mine = []
        for (where, p), a in good.items():
            if where == lang and 100 * around[lang, p] < co.COVERED * a:
                cuts = [
                    (co.SCALE * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))
                ]
                score, k = min(cuts)
                mine.append((score, a, " ".join(p), counts[lang, p[:k]], counts[lang, p[k:]]))
        mine.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        for rank, (score, a, phrase, left, right) in enumerate(mine[:top], 1):
            out.append((lang, rank, phrase, a, left, right, totals[lang], score))
    return sorted(out)


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def prose(seed, sentences):
    """Invented text with set phrases of every length, overlaps, and marks between the words."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(30)] + ["Ä", "é", "x y", "\x85", "A-b"]
    sayings = ["New York City", "in the year of", "in the year", "tick tick tick tick tick", "a b", "B a b A", "of of"]
    out = []
    for _ in range(sentences):
        words = rng.choices(names, k=rng.randrange(1, 9))
        words.insert(rng.randrange(len(words) + 1), rng.choice(sayings))
        out.append(rng.choice([" ", "\t", "  "]).join(words) + rng.choice([". ", ", ", "\n", "\r\n", " ", "!?"]))
    return "".join(out)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_phrases(spark, monkeypatch, block):
    monkeypatch.setattr(co, "BLOCK_WORDS", block)
    langs = ["en", "de", None, ""]
    docs = [(langs[i % 4], prose(i, 60)) for i in range(40)] + [("en", None), (None, ""), ("en", " . ! ")]
    docs += docs[:3]  # repeated rows
    df = spark.createDataFrame([(i, t, g, 3) for i, (g, t) in enumerate(docs)], "a long, text string, lang string, n int")
    got = found(co.collocations(df.repartition(5), least=8))
    assert got == brute(docs, 8) and len(got) > 50
    assert {len(r[2].split(" ")) for r in got} == {2, 3, 4}
    few = found(co.collocations(df, least=8, top=3))
    assert few == brute(docs, 8, 3)


def test_one_long_text_and_one_phrase(spark):
    docs = [("en", "x y " * 50_000), ("en", "x y " * 40), ("fr", "seul " * 29)]
    df = spark.createDataFrame([(t, g) for g, t in docs], "text string, lang string")
    assert found(co.collocations(df)) == brute(docs, 30)


def test_blocks_of_a_task_are_held_one_by_one(spark, monkeypatch):
    """Many blocks of one task: each is a row group, and no plan gathers or zips entries into lists of objects."""
    monkeypatch.setattr(co, "BLOCK_WORDS", 40)
    batches = "spark.sql.execution.arrow.maxBytesPerBatch"
    groups, plans, sizes, own, before = {}, [], set(), co.staged, spark.conf.get(batches)

    def spied(df, purpose, *options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        sizes.add(spark.conf.get(batches))
        out = own(df, purpose, *options)
        for file in out.inputFiles():
            data = pq.ParquetFile(Path(file.removeprefix("file:"))).metadata
            groups.setdefault(purpose, []).extend(data.row_group(i).num_rows for i in range(data.num_row_groups))
        return out

    monkeypatch.setattr(co, "staged", spied)
    docs = [("en", prose(i, 60)) for i in range(20)]
    df = spark.createDataFrame([(t, g) for g, t in docs], "text string, lang string").coalesce(1)
    assert found(co.collocations(df, least=8)) == brute(docs, 8)
    for purpose in ("collocation-words", "collocation-occurrences", "collocation-candidates"):
        assert set(groups[purpose]) == {1} and len(groups[purpose]) >= 20, purpose
    assert not [p for p in plans if "collect_list" in p or "arrays_zip" in p]
    assert sizes == {"4m"} and spark.conf.get(batches) == before


def test_awkward_and_empty(spark):
    df, rows = awkward(spark, ["a b, a b", "", "c " * 40, "A B"])
    assert found(co.collocations(df, least=2)) == brute([(r[2], r[1]) for r in rows], 2)
    assert found(co.collocations(empty(spark))) == []
    assert found(co.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string"))) == []


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_registered_query_and_its_sql(spark, folder):
    where = f"/root/testdata/{folder}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op12_collocations"])
    names = [d[0] for d in want.description]
    got = QUERIES["op12_collocations"](spark, where)
    assert found(got) == sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in want.fetchall())
    docs = con.execute("SELECT lang, text FROM documents").fetchall()
    assert found(got) == brute(docs, co.LEAST)
