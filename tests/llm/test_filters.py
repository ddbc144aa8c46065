"""URL rules, quality rules, quotation linking and shards."""

import collections
import math
import zlib

import duckdb
import pytest
from helpers import awkward, empty, words
from pyspark.sql import functions as F

from goldseam.llm import oracles, quality, quotes, shards, url_filter
from goldseam.llm.common import blocked_running_sum, fresh
from goldseam.llm.queries import URL_RULES, op10_shards


def compare(df, sql, tables):
    """Rows of ``df`` and of DuckDB's ``sql`` over ``tables`` (name: (DDL, rows))."""
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = collections.Counter(cursor.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(map(tuple, df.select(*names).collect())) == want
    return want


URLS = [
    "https://a.example.net/en/1?x=/de/", "http://EXAMPLE.net/EN/1", "http://example.net/en", "http://net", "http://net/",
    "http://badexample.com/de/x", "http://m.example.com/de/", "x://example.com/de/y#z", "no scheme", "", None,
    "http://org/fr/", "http://a.b.org/fr/2://x", "http:///de/", "http://user@x.net:80/", "http://x.net./a", "://net/",
    "ftp://foo.org/en/", "http://Ünï.NET/é", "http://a.net?q", "http://example.com/de",
]


def test_url_rules(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS)] * 2 + [(None, URLS[0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    rules = url_filter.rule_table(spark, URL_RULES)
    got = url_filter.judged(pages, rules)
    ddl = "page_id BIGINT, url VARCHAR, host VARCHAR, path VARCHAR"
    sql = oracles.url_filter(URL_RULES).replace("FROM pages", "FROM (SELECT page_id, url FROM pages)")
    want = compare(got, sql, {"pages": (ddl, rows)})
    assert {r[4] for r in want} == {"allow", "block"} and len({r[3] for r in want}) == 5
    kept = url_filter.allowed(pages, rules)
    assert kept.columns == pages.columns
    assert kept.count() == sum(n for r, n in want.items() if r[4] == "allow")
    assert url_filter.judged(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judged(pages, url_filter.rule_table(spark, []), "block").collect()} == {"block"}


def test_rules_lie_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("a.net", "/en/x"), ("b.net", "/x"), ("c.net", "/de/")], "host string, path string")
    listed = [url_filter.UrlRule("block", "net", "/en/"), url_filter.UrlRule("allow", "", "/x")]
    index = {r.rule: r.token for r in url_filter.rule_index(urls, url_filter.rule_table(spark, listed)).collect()}
    assert index == {"net/en/": "p:en", "/x": ""}


def slow_features(text):
    w = [x for x in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        len(lines),
    )


def quality_texts():
    return [
        " ".join(words(1, 200)), "a b c d e " * 30, "x\ny\nx\n x\n\ny", "#*$ %&|<> é🙂 " * 5, " \t\n\x0b\f\r", "\x85 \xa0 w",
        " ".join(words(2, 30000, 40)), "one two three four five " * 2 + " ".join(words(3, 60)), "same same same same same same",
    ]


def test_features(spark):
    docs, rows = awkward(spark, quality_texts())
    extra = docs.withColumnsRenamed({"hash": "_t", "place": "_w", "row": "n"})
    got = quality.with_features(extra).collect()
    want = collections.Counter((r[0], *slow_features(r[1])) for r in rows)
    assert collections.Counter((r.doc_id, *[r[f] for f in quality.FEATURES]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


@pytest.mark.parametrize("p", [0.004, 0.05])
def test_binomial_tail(spark, p):
    cases = [(n, k) for n in (1, 10, 100, 2000, 30_000) for k in {0, 1, int(n * p / 2), int(n * p) - 1} if 0 <= k < n * p]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), p).alias("t")).collect():
        exact = sum(
            math.exp(
                math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1)
                + i * math.log(p) + (r.n - i) * math.log1p(-p)
            )
            for i in range(r.k + 1)
        )
        assert r.t == pytest.approx(exact, rel=1e-7)


def labelled(spark):
    """Two languages: one with enough good labels to certify cutoffs, one without."""
    good, symbols = " ".join(words(9, 40)), " ".join(f"#{i}*$%&" for i in range(40))
    rows = [(i, f"{good} n{i}", "en") for i in range(4000)] + [(9000 + i, f"{symbols} n{i}", "en") for i in range(40)]
    rows += [(20_000 + i, f"{symbols} n{i}", "de") for i in range(30)] + [(30_000, symbols, None), (None, good, "en")]
    labels = [(i, 1, 0) for i in range(4000)] + [(9000 + i, 0, 0) for i in range(40)] + [(1, 0, None), (None, 1, 1), (3, None, 0)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        rows,
        labels,
    )


def test_cutoffs_are_certified_per_stratum(spark):
    docs, labels, rows, marks = labelled(spark)
    got = quality.quality_verdicts(docs, labels)
    want = compare(
        got,
        oracles.quality(),
        {
            "documents": ("doc_id BIGINT, text VARCHAR, lang VARCHAR", rows),
            "labels": ("doc_id BIGINT, quality INTEGER, toxic INTEGER", marks),
        },
    )
    verdicts = {r[0]: r[8] for r in want}
    assert all(verdicts[i] for i in range(4000))
    assert not any(verdicts[9000 + i] for i in range(40))  # rejected in the stratum that has labels
    assert all(verdicts[20_000 + i] for i in range(30)) and verdicts[30_000]  # nothing can be shown there
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for r, n in want.items() if r[8])


def test_quality_of_empty_tables(spark):
    docs, labels, _, _ = labelled(spark)
    assert quality.quality_verdicts(docs.limit(0), labels).collect() == []
    assert quality.keep_good(docs.limit(50), labels.limit(0)).count() == 50
    assert quality.keep_good(empty(spark), labels).collect() == []


MESSAGES = [
    (1, 0, "user", "Hello there\nhow are you?\nBye"), (1, 1, "assistant", "> Hello  there\n> how are YOU?\nFine."),
    (1, 2, "user", "Unrelated"), (1, 3, "user", ">> hello there\n> Fine.\nGood\n\n> nothing"),
    (1, 4, "a", "> Unrelated\nok"), (1, 5, "b", "> Good\n> Unrelated\nhmm"), (None, 0, "u", "x y"),
    (None, None, "u", None), (None, 2, None, "> x\n> y\n"), (2, 0, "u", ""), (2, 1, "u", "> self\nself"),
    (3, 7, "u", "a"), (3, 8, "u", "> a"), (3, 9, "u", "> a\n>> a\nb"), (3, 10, "u", ">b\nc"), (3, 11, "u", "> c\nd"),
    (4, 0, "u", "long " * 5000), (4, 1, "u", "> " + "long " * 5000), (4, 2, "u", "  > > deep\n    > code"), (4, 9, "u", "> a"),
]
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_quotation_linking(spark):
    got = quotes.linked_messages(spark.createDataFrame(MESSAGES, CONVERSATIONS))
    ddl = "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR"
    compare(got, oracles.quotation_linking(), {"conversations": (ddl, MESSAGES)})
    order = [r.turn for r in got.where("conv_id = 1").orderBy("position").collect()]
    assert order == [0, 1, 3, 5, 2, 4]


def test_long_chain_and_repeated_rows(spark):
    chain = [(1, 0, "u", "m0")] + [(1, i, "u", f"> m{i - 1}\nm{i}") for i in range(1, 60)]
    got = quotes.linked_messages(spark.createDataFrame(chain + [chain[7], chain[7]], CONVERSATIONS)).collect()
    assert {r.thread_turn for r in got} == {0}
    assert sorted(r.position for r in got) == list(range(62))
    assert all(r.reply_to == r.turn - 1 for r in got if r.turn)
    assert [r.body for r in got if r.turn == 7] == ["m7"] * 3


def test_conversations_in_parts(spark):
    rows = [(1, i, "u", f"m{i}") for i in range(25)]
    got = quotes.formatted(quotes.linked_messages(spark.createDataFrame(rows, CONVERSATIONS)), part=10)
    parts = {r.part: (r.n_messages, r.text) for r in got.collect()}
    assert [parts[p][0] for p in range(3)] == [10, 10, 5]
    assert parts[2][1] == "\n".join(f"<|u|>\nm{i}" for i in range(20, 25))
    none = spark.createDataFrame([], CONVERSATIONS)
    assert quotes.linked_messages(none).collect() == []


def test_blocked_running_sum(spark):
    rows = [(k, i, (i * 7) % 5) for k in (None, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = blocked_running_sum(df, ["k"], ["i"], "v", "s", block=8).collect()
    assert len(got) == 100
    assert all(r.s == sum((j * 7) % 5 for j in range(r.i)) for r in got)


def check_shards(rows, got):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None
    )
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    homes = collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        homes[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_BYTES", 2000)
    rows = [(i, " ".join(words(i, i % 30))) for i in range(600)] + [(5, "x" * 9000), (5, None), (None, "n"), (None, "n")]
    rows += [(77, "same")] * 300
    docs = spark.createDataFrame([(*r, {"k": 1}, 3, 4) for r in rows], "doc_id long, text string, m map<string,int>, shard int, bucket int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_shards(spark, str(tmp_path)).collect()
    check_shards(rows, got)
    sizes = collections.Counter(r.shard for r in got if r.doc_id != 77)
    assert len(sizes) == 16 and max(sizes.values()) < 3 * min(sizes.values())
    here = [r.doc_id for r in sorted((r for r in got if r.shard == sizes.most_common(1)[0][0]), key=lambda r: r.slot)]
    assert here != sorted(here, key=lambda x: x or 0)


def test_shards_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    shards.write_shards(empty(spark), path, 4)
    assert shards.read_shards(spark, path, empty(spark).schema).collect() == []


def test_names():
    assert fresh(["a", "_A", "_a_"], "_a") == "_a__"
