"""SimHash components, line classes, benchmark search and union-find against brute force."""

import collections
import random

import numpy as np
import pytest
import xxhash
from helpers import Components, awkward, empty, words
from pyspark.sql import functions as F

from goldseam.llm import decontaminate, line_dedup, simhash
from goldseam.llm.components import components


def test_fours_avoid_any_three_positions():
    from itertools import combinations

    for three in combinations(range(8), 3):
        assert any(not set(four) & set(three) for four in simhash.FOURS)
    assert len(simhash.FOURS) == 14


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.translate({c: " " for c in range(9, 14)}).split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies():
    base = words(1, 300)
    texts = [" ".join(base)]
    for i in range(40):
        copy = list(base)
        copy[(7 * i) % 300] = f"other{i % 9}"
        texts.append(" ".join(copy))
    texts += [" ".join(words(s, 80)) for s in range(2, 40)]
    return [*texts, "One two", "one TWO", "\u00c9t\u00e9 \u00e9t\u00e9", "x\x85y z\x1cq", " \t\x0b", "a b c " * 4000]


def test_simhash_components(spark):
    docs, rows = awkward(spark, near_copies())
    got = simhash.near_duplicates(docs).collect()
    prints = [slow_fingerprint(r[1]) for r in rows]
    own = Components()
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                own.join(a, b)
    least = {}
    for r, f in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[own.find(f)] = min(least.get(own.find(f), r[0]), r[0])
    want = collections.Counter((r[0], f, least.get(own.find(f))) for r, f in zip(rows, prints, strict=True))
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    groups = {own.find(f) for f in prints}
    assert kept.count() == len(groups)
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.keep_one_per_component(empty(spark)).collect() == []


def test_long_posting_lists_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_LIMIT", 20)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 300:
        f = base
        for b in rng.integers(0, 64, int(rng.integers(1, 9))):
            f ^= 1 << int(b)
        fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    got = Components()
    for a, b in links.collect():
        got.join(a % (1 << 64), b % (1 << 64))
    want = Components()
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                want.join(a, b)
    assert {f: got.find(f) for f in fps} == {f: want.find(f) for f in fps}


def test_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 700)]
    edges += [tuple(map(int, rng.integers(1000, 1300, 2))) for _ in range(200)] + [(3, 3), (1, 0), (0, 1)]
    want = Components()
    for a, b in edges:
        want.join(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), "test")
    pairs = [(r.node, r.root) for r in got.collect()]
    assert len(pairs) == len({n for n, _ in pairs})
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert dict(pairs) == {x: want.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def shingle_set(line):
    return {line} if len(line) <= 7 else {line[i : i + 7] for i in range(len(line) - 6)}


def slow_lines(rows):
    """(doc_id, line_no, first of its class) of all lines with a word, by comparing all pairs."""
    lines = []
    for n, r in enumerate(rows):
        for i, raw in enumerate((r[1] or "").split("\n")):
            line = raw.strip(" \t\x0b\f\r").replace("\x01", " ")
            if line:
                lines.append((n, r[0], i, line))
    sets = {x[3]: shingle_set(x[3]) for x in lines}
    own = Components()
    each = sorted(sets)
    for i, a in enumerate(each):
        for b in each[i:]:
            shared = len(sets[a] & sets[b])
            if shared * 100 >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                own.join(a, b)
    return lines, own


def line_texts():
    long = " ".join(words(4, 90))
    base = " ".join(words(5, 30))
    texts = ["first line\nsecond  line\n\nfirst line", long + "\n" + base, "x" * 5000 + "\ny"]
    for i in range(25):
        changed = base.split()
        changed[i] = f"zz{i}"
        other = long.split()
        other[i] += "s"
        texts.append(" ".join(changed) + "\n" + " ".join(other) + "\nown " + " ".join(words(50 + i, 12)))
    texts += ["tiny", "Tiny", "tiny ", "\t\n \n", "日本語の文章はここに単語の間の空白なしで書かれています。" * 9, "é" * 400]
    texts += ["日本語の文章はここに単語の間の空白なしで書かれています。" * 9 + "終", "a\x01b c d e f g h"]
    return texts


def test_line_classes(spark):
    docs, rows = awkward(spark, line_texts())
    lines, own = slow_lines(rows)
    first = {}
    for _, doc, i, line in sorted(lines, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[0])):
        first.setdefault(own.find(line), (doc, i))
    want = collections.Counter((doc, i, *first[own.find(line)]) for _, doc, i, line in lines)
    got = line_dedup.line_classes(docs).collect()
    assert collections.Counter((r.doc_id, r.line_no, r.class_doc_id, r.class_line_no) for r in got) == want
    kept = collections.Counter((r.class_doc_id, r.class_line_no) for r in got if r.kept)
    assert set(kept) == set(first.values())
    assert line_dedup.line_classes(empty(spark)).collect() == []


def family(seed, size, shared, own, changes):
    """Lines of one template with a part of their own, each with a near copy that has a few changed characters."""
    random.seed(seed)

    def text(n):
        return "".join(random.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(n)).replace("  ", "q ")

    template, lines = "t" + text(shared - 1), []
    for _ in range(size):
        line = f"{template}{text(own - 1)}y"
        copy = list(line)
        for i in random.sample(range(shared, len(line) - 1), changes):
            copy[i] = random.choice("0123456789")
        lines += [line, "".join(copy)]
    return lines


def missed_links(spark, lines):
    """How many links there are that agree in two bands, and those of them whose lines line_links keeps apart."""
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("id"), "line")
    ids = {r.line: r.id for r in df.collect()}
    bands = collections.defaultdict(set)
    for r in line_dedup.band_keys(line_dedup._signature_sets(df.withColumn("copies", F.lit(1)))).collect():
        bands[r.id].add(r.band)
    root = {r.node: r.root for r in line_dedup.line_links(df).collect()}
    sets = {x: shingle_set(x) for x in ids}
    posted = collections.defaultdict(list)
    for x, s in sets.items():
        for g in s:
            posted[g].append(x)
    # what half of the lines share links none of them
    near = {(a, b) for p in posted.values() if len(p) < len(ids) // 2 for a in p for b in p if a < b}
    links = [
        (a, b) for a, b in near
        if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]) and len(bands[ids[a]] & bands[ids[b]]) > 1
    ]
    return len(links), [(a, b) for a, b in links if ids[a] not in root or root[ids[a]] != root.get(ids[b])]


def test_template_lines_with_one_near_copy(spark):
    found, missed = missed_links(spark, family(1, 400, 120, 30, 3))
    assert found > 200 and missed == []


def long_word_lines(pairs, size, word, changes):
    """Independent lines of long words, each followed by a copy with a few changed characters."""
    random.seed(size * word)
    lines = []
    for _ in range(pairs):
        line = " ".join(
            "".join(random.choice("abcdefghijklmnop/._-") for _ in range(word)) for _ in range(size // (word + 1))
        )
        copy = list(line)
        for i in random.sample([i for i, x in enumerate(line) if x != " "], changes):
            copy[i] = "#"
        lines += [line, "".join(copy)]
    return lines


def linked_pairs(spark, lines):
    """Similar pairs of a line and its copy, and those of them that line_links connects."""
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("id"), "line")
    ids = {r.line: r.id for r in df.collect()}
    root = {r.node: r.root for r in line_dedup.line_links(df).collect()}
    pairs = [
        (a, b) for a, b in zip(lines[::2], lines[1::2], strict=True)
        if len(shingle_set(a) & shingle_set(b)) * 100 >= 80 * len(shingle_set(a) | shingle_set(b))
    ]
    return len(pairs), sum(ids[a] in root and root[ids[a]] == root.get(ids[b]) for a, b in pairs)


def test_long_lines_of_long_words(spark):
    lines = [x for size, word, n in ((300, 20, 3), (400, 20, 4), (400, 12, 4)) for x in long_word_lines(100, size, word, n)]
    found, linked = linked_pairs(spark, lines)
    assert found > 250 and linked >= 0.99 * found


def test_near_copies_in_a_crowd(spark):
    found, missed = missed_links(spark, family(1, 1000, 120, 30, 3))
    assert found > 500 and missed == []


def test_lines_are_taken_out(spark):
    docs, rows = awkward(spark, line_texts())
    got = line_dedup.without_repeated_lines(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out if r.doc_id not in (None, 0)}
    # the null id comes first, so its copy of the first text keeps the lines
    assert {r.text for r in out if r.doc_id is None} == {"first line\nsecond  line\n", None}
    assert {r.text for r in out if r.doc_id == 0} == {""}
    assert by_id[1].text == line_texts()[1]
    assert by_id[4].text.startswith("own ") and by_id[4].n_chars == len(by_id[4].text)
    assert line_dedup.without_repeated_lines(empty(spark)).collect() == []


def test_shingles_are_complete(spark):
    lines = ["", "a", "1234567", "12345678", "aé日🙂 bcdefgh ijk", "x" * 300]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for row in df.select("line", line_dedup.shingles("line").alias("s")).collect():
        assert set(row.s) == shingle_set(row.line)


def slow_containment(docs, items):
    def grams(text):
        w = decontaminate.words_of(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    found = []
    for d, text in docs:
        have = grams(text)
        for i, item in items:
            need = grams(item)
            if need and len(have & need) * 100 >= 80 * len(need):
                found.append((d, i, len(have & need), len(need)))
    return sorted(found, key=repr)


def test_contained_items(spark):
    items = [(i, " ".join(words(100 + i, n))) for i, n in enumerate([5, 6, 9, 14, 30, 60, 200, 60])]
    items += [(8, items[3][1]), (9, "too short item here"), (10, None), (11, ""), (None, items[4][1])]
    long = words(7, 20_000)
    texts = ["Nothing here at all, really nothing to see.", None, ""]
    for i, (_, item) in enumerate(items[:8]):
        w = item.split()
        texts.append(" ".join(long[:300] + w + long[300:320]))
        texts.append(" ".join(["pre"] * 3 + w[: max(5, int(len(w) * 0.86))] + ["post"]))
        texts.append(" ".join(w[: len(w) // 2]))
        texts.append(" ".join(long[: 5000 * (i % 4)] + w + long))
    texts.append(items[4][1].upper().replace(" ", ", "))
    docs, rows = awkward(spark, texts)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, row string, hash int")
    got = decontaminate.find_items(docs, table)
    want = slow_containment([(r[0], r[1]) for r in rows], items)
    assert sorted([(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()], key=repr) == want
    bad = {w[0] for w in want}
    kept = decontaminate.without_items(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - (bad - {None})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(docs, none).collect() == []
    assert decontaminate.find_items(empty(spark), table).collect() == []
    assert decontaminate.without_items(docs, none).count() == len(rows)


@pytest.mark.parametrize("n", range(1, 400))
def test_signature_covers_what_may_be_missing(n):
    missing = n - -(-n * 80 // 100)
    assert missing < decontaminate.signature_size(n) <= n


def test_line_classes_delete_their_scratch(spark):
    import os

    from goldseam.llm.common import recorded

    texts = [f"line number {i % 7} of a text with some words\nanother line {i} of it, quite long as well" for i in range(30)]
    docs, _ = awkward(spark, texts)
    with recorded() as paths:
        with recorded() as inner:
            pass
        classes = line_dedup.line_classes(docs)
    assert inner == [] and paths
    kept = [p for p in paths if os.path.exists(p.removeprefix("file:"))]
    assert sorted(p.split("/")[-2] for p in kept) == ["line-roots", "lines"]
    assert classes.count() == 2 * (len(texts) + 3)


def short_lines():
    """Short lines, each with a copy of which one end is changed; and lines of a few shingles, many times each."""
    random.seed(11)
    lines = []
    for i in range(400):
        line = "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(10 + i % 40)) + "."
        lines += [line, line + "!" if i % 2 else "#" + line[1:]]
    for i, unit in enumerate(("x", "-", "ab", "abc", "=+", "12345")):
        lines += [unit * (16 + i), unit * 900]
    return lines


def test_short_lines_and_lines_of_few_shingles(spark):
    found, linked = linked_pairs(spark, short_lines())
    assert found > 300 and linked == found


def test_signature_has_a_row_for_every_shingle(spark):
    """Shingles are rows that the next aggregate folds, not arrays of texts that a regular expression cuts."""
    lines = ["abc", "1234567", "aé日🙂 bcdefgh ijk", "x" * 300]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(lines)], "id long, line string, copies long")
    rows = collections.Counter(r.id for r in line_dedup._signature_sets(df).collect())
    assert rows == {i: max(len(x) - 6, 1) for i, x in enumerate(lines)}


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from goldseam.llm.common import staged

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    env, before = spark._jvm.org.apache.spark.SparkEnv, spark.conf.get(key)

    def files():
        names = env.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {x for x in names if x.rsplit("/", 1)[-1].startswith("shuffle_")}

    old = files()
    table = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    end = time.time() + 10
    while files() - old and time.time() < end:
        time.sleep(0.2)
    assert files() - old == set()
    assert table.count() == 7 and spark.conf.get(key) == before
