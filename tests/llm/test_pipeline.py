"""The pipeline on a small corpus, stage by stage against brute force."""

from helpers import Components, words
from test_filters import slow_features
from test_near_duplicates import slow_containment, slow_fingerprint, slow_lines

import corpus_pipeline
from goldseam.llm import prefix_bpe
from goldseam.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp long"


def corpus():
    item = " ".join(words(400, 40))
    texts = {i: "\n".join(" ".join(words(1000 * i + j, 40)) for j in range(3)) for i in range(30)}
    texts[30] = texts[3]
    texts[31] = texts[4].replace(" ", "  ", 1)
    near = texts[5].split("\n")
    texts[32] = "\n".join([near[0].rsplit(" ", 1)[0] + " changed", *near[1:], " ".join(words(77, 45))])
    texts[33] = " ".join(words(88, 30)) + " " + item + " " + " ".join(words(89, 30))
    texts[34], texts[35], texts[36] = "too few words", None, ""
    texts[37] = "again and again it says so " * 20
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "k", 1) for i, t in texts.items()]
    return [*rows, rows[7], rows[7]], [(1, item), (2, "short one")]


def brute(rows, items):
    """Ids and texts that are left after each stage, by plain loops."""
    rows = [r for r in rows if not (lambda f: f[0] < 10 or 100 * f[4] > 20 * f[0])(slow_features(r[1]))]
    yield rows
    lines, own = slow_lines(rows)
    first = {}
    for n, _, i, line in sorted(lines, key=lambda x: (x[1], x[2], x[0])):
        first.setdefault(own.find(line), (n, i))
    gone = {(n, i) for n, _, i, line in lines if first[own.find(line)] != (n, i)}
    cut = []
    for n, r in enumerate(rows):
        text = "\n".join(x for i, x in enumerate(r[1].split("\n")) if (n, i) not in gone)
        cut.append((r[0], text, *r[2:]))
    rows = cut
    yield rows
    prints = [slow_fingerprint(r[1]) for r in rows]
    groups = Components()
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                groups.join(a, b)
    best = {}
    for r, f in sorted(zip(rows, prints, strict=True), key=lambda x: x[0][0]):
        best.setdefault(groups.find(f), r)
    rows = list(best.values())
    yield rows
    bad = {d for d, *_ in slow_containment([(r[0], r[1]) for r in rows], items)}
    yield [r for r in rows if r[0] not in bad]


def test_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(rows, items), strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        assert got == sorted((r[0], r[1]) for r in want), name
    final = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()))
    assert [r[0] for r in final] == sorted(r[0] for r in want)
    counts = sorted((r[0], len(prefix_bpe.encode_text(r[1], "word_bpe_49k.json"))) for r in want)
    assert [r[:2] for r in final] == counts
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == final


def test_registry():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert set(ORACLE_SQL) < set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
