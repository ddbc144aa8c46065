"""Fuzzy line deduplication: MinHash of character shingles, exact Jaccard, one line kept per component.

Lines are compared as their 7-character shingles (after trimming ASCII white space; a shorter line is one
shingle). Lines whose shingle sets have a Jaccard similarity of 0.8 or more are linked, links are followed,
and of each component the first line stays, by (doc_id, line number). Everything is DataFrame operations.

Signature. One hash per shingle; the hash range is cut into bins, the least hash of a bin is its MinHash
value, and an empty bin takes that of the next filled one. A few bins make a band; lines that agree in a
band are candidates. At similarity 0.8 two lines agree in one of fourteen bands of four all but once in a
thousand times, in two of them all but about seven times; above it, more surely. All shingles of a line are
signed, whatever its length and words, so that the signature estimates the similarity that is decided.

A line's id is 64 bits of hash of its text. Two different lines share one with a chance of 1 in 37
for a corpus of 10^9 different lines; they would count as copies.

Candidates agree in two bands: two bands hold hardly a line that is not similar, however common the
shingles of one band are. First every line is compared with a pivot that it meets in two buckets, a bucket's
pivot being its line with the most copies: in a group of near copies that is the original, and one
comparison per line connects the group. Then lines that agree in two bands and are still in different
components are compared with each other. Where more than CROWD such lines agree in the same two bands (a
crowd of copies with many changes), all lines of such crowds are put under their rarest shingles, as many as
two similar lines must share one of (prefix filter), and those that meet there are compared. This loses no
similar pair, and lines with nothing but a template in common do not meet.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import dropped, fresh, if_small, recorded, setting, staged
from goldseam.llm.components import components

SHINGLE = 7
#: Linked from this similarity on, in percent.
SIMILARITY = 80
#: Bands of a signature, and bins of a band.
BANDS, ROWS = 14, 4
#: A task folds shingles to some hundred thousand (line, band) groups; Spark's faster map holds 2^16 unless told more.
GROUPS = ("spark.sql.codegen.aggregate.fastHashMap.capacityBit", "20")
#: Shingles that are cut from one piece of a line.
PIECE = 16
#: Lines of a bucket that are all compared with each other; lines of larger ones meet by their rarest shingles.
CROWD = 16

_BLANKS = " \t\x0b\f\r"
_MARK = "\x01"


def document_lines(docs: DataFrame, place: str) -> DataFrame:
    """(place, doc_id, line_no, id, line) of every line with a word; line_no counts all lines from 0.

    ``line`` is trimmed, and ``id`` a hash that stands for its text.
    """
    split = docs.select(place, "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # most lines are trimmed already, and to trim reads every character
    line = F.col("line")
    blank = reduce(or_, [edge(x) for x in _BLANKS for edge in (line.startswith, line.endswith)])
    line = F.replace(F.when(blank, F.btrim("line", F.lit(_BLANKS))).otherwise(line), F.lit(_MARK), F.lit(" "))
    return split.withColumn("line", line).where("line != ''").withColumn("id", F.xxhash64("line"))


def _hash(*parts) -> Column:
    """63 bits of hash, so that the natural order of longs is the order of bins."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 1)


def _starts(wide: Column, step: int = 1) -> Column:
    """Where every ``step``-th shingle of a line with four bytes a character starts; a short line is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.length(wide) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4 * step))


def _of_shingles(line: str, value) -> Column:
    """``value`` of every shingle of a line in order.

    The line is encoded once with four bytes a character, so that cutting a shingle does not look for its start.
    """
    wide = F.array(F.encode(line, "UTF-32"))  # a variable of the outer transform is not encoded or copied again
    return F.transform(
        wide, lambda b: F.transform(_starts(b), lambda at: value(F.substring(b, at, F.lit(4 * SHINGLE))))
    )[0]


def _decoded(shingle: Column) -> Column:
    """Text of four bytes a character; the mark before it is the one that the decoder takes off."""
    return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), shingle), "UTF-32")


def shingles(line: str) -> Column:
    """All shingles of a line in order, as text."""
    return _of_shingles(line, _decoded)


def _distinct_shingles(line: str) -> Column:
    """The shingles of a line as different 64-bit hashes."""
    return F.array_distinct(_of_shingles(line, F.xxhash64))


def _signature_sets(lines: DataFrame) -> DataFrame:
    """(id, copies, hash): the hashes of all shingles of every line, a row each, which no shuffle sees.

    A line is cut into pieces of PIECE shingles, so that the cost does not grow with the square of its length.
    """
    wide = lines.select("id", "copies", F.encode("line", "UTF-32").alias("wide"))
    at = wide.select("id", "copies", "wide", F.explode(_starts(F.col("wide"), PIECE)).alias("at"))
    piece = _decoded(F.substring("wide", F.col("at"), F.lit(4 * (PIECE + SHINGLE - 1))))
    pieces = at.select("id", "copies", piece.alias("piece"))
    cut = F.sequence(F.lit(1), F.greatest(F.length("piece") - (SHINGLE - 1), F.lit(1)))
    rows = pieces.select("id", "copies", "piece", F.explode(cut).alias("at"))
    return rows.select("id", "copies", _hash(F.substring("piece", F.col("at"), F.lit(SHINGLE))).alias("hash"))


def _signatures(sets: DataFrame) -> DataFrame:
    """(id, copies, bands): the keys of every line of ``sets``."""
    bits = (BANDS * ROWS - 1).bit_length()
    shift = 63 - bits
    at = f"cast(shiftright(hash, {shift}) as int)"
    dealt = sets.selectExpr("id", "copies", "hash", f"cast({at} div {ROWS} as int) AS b", f"{at} % {ROWS} AS r")
    least = [F.min(F.when(F.col("r") == r, F.col("hash"))).alias(f"least_{r}") for r in range(ROWS)]
    rows = dealt.groupBy("id", "copies", "b").agg(*least)
    # a value fills its own bin and the empty ones before it, the first of a line also those behind the last
    own = F.array(*[F.coalesce(*[f"least_{i}" for i in range(r, ROWS)]) for r in range(ROWS)])
    rows = rows.select("id", "copies", own.alias("own"), F.col(f"least_{ROWS - 1}").alias("end"))
    rows = rows.groupBy("id", "copies").agg(
        F.flatten(F.sort_array(F.collect_list("own"))).alias("flat"), F.count("end").alias("ends")
    )
    whole = F.when(F.col("ends") * ROWS == 1 << bits, F.col("flat"))
    rows = rows.select("id", "copies", whole.otherwise(F.array_distinct(F.array_compact("flat"))).alias("least"))
    here, prior = f"shiftright(x, {shift})", f"shiftright(least[i - 1], {shift})"
    behind = f"{(1 << bits) - 1} - shiftright(least[size(least) - 1], {shift})"
    filled = (
        f"concat(flatten(transform(least, (x, i) -> array_repeat(x, cast({here} - if(i = 0, -1L, {prior}) as int)))),"
        f" array_repeat(least[0], cast({behind} as int)))"
    )
    full = F.when(F.size("least") == 1 << bits, F.col("least")).otherwise(F.expr(filled))
    rows = rows.select("id", "copies", full.alias("full"))
    keys = [F.xxhash64(F.lit(b), *[F.col("full")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)]
    return rows.select("id", "copies", F.array(*keys).alias("bands"))


def _listed(signed: DataFrame) -> DataFrame:
    return signed.select("id", "copies", F.explode("bands").alias("band"))


def band_keys(sets: DataFrame) -> DataFrame:
    """(id, copies, band): the keys under which the lines of ``sets`` meet their candidates."""
    return _listed(_signatures(sets))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose lines are similar; ``texts`` has id and line of every line in a pair.

    All shingles of both lines are compared, as 64-bit hashes.
    """
    one = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    two = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    sets = (
        pairs.join(one, "a")
        .join(two, "b")
        .select(
            "a", "b",
            _distinct_shingles("line_a").alias("sa"),
            _distinct_shingles("line_b").alias("sb"),
        )
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    similar = shared * 100 >= (F.size("sa") + F.size("sb") - shared) * SIMILARITY
    return sets.where(similar).select("a", "b")


def _buckets(lines: DataFrame) -> DataFrame:
    """(band, id, pivot) of every line in a bucket with another one.

    Copies of a line are folded first, so a line with a third of all rows is one member of its buckets.
    The pivot is the line with the most copies. Lines that are alone in a bucket leave it before anything
    is sorted; the one shuffle of all keys serves the count and the look-up.
    """
    distinct = lines.groupBy("id").agg(F.first("line").alias("line"), F.count("*").alias("copies"))
    with setting(lines.sparkSession, *GROUPS):
        # written a row a line, so that the shuffled texts are gone when the keys are shuffled
        signed = staged(_signatures(_signature_sets(distinct)), "line-signatures")
    keyed = _listed(signed).repartition("band")
    met = keyed.groupBy("band").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.max("copies").alias("most")
    )
    met = met.where("low != high").select("band", "most")
    with setting(lines.sparkSession, *GROUPS):
        shared = staged(keyed.join(met.hint("shuffle_hash"), "band"), "line-bands")
    pivots = shared.where("copies = most").groupBy("band").agg(F.min("id").alias("pivot"))
    return shared.join(pivots, "band").select("band", "id", "pivot")


_TWICE = "flatten(transform(bands, (x, i) -> transform(slice(bands, i + 2, size(bands)), y -> xxhash64(x, y))))"


def _agreeing(listed: DataFrame) -> DataFrame:
    """(key, id, root, members): lines by pairs of their bands, of keys that lines of several components share."""
    keyed = listed.select(F.explode(F.expr(_TWICE)).alias("key"), "id", "root")
    met = keyed.groupBy("key").agg(
        F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    return keyed.join(met.where("low != high").select("key", "members"), "key")


def _all_pairs(buckets: DataFrame) -> DataFrame:
    """(id, other) of lines that share a bucket of at most CROWD lines and no component."""
    small = buckets.where(f"members <= {CROWD}").select("key", "id", "root")
    other = small.select("key", F.col("id").alias("other"), F.col("root").alias("other_root"))
    return small.join(other, "key").where("id < other AND root != other_root").select("id", "other")


def _prefix_pairs(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, other) of lines of ``crowd`` (id, root) in different components: every similar pair, and few others.

    Shingles are ordered by how many lines of the crowd have them. Lines of x and y shingles, x <= y, are
    similar only if they share 4/9 (x + y) of them, so the first shingle they share is among the first
    x - 8/9 x + 1 of the one and the first y - 4/5 y + 1 of the other, and enough shingles follow it in
    both. A shingle's lines in its largest component do not meet each other.
    """
    cut = _distinct_shingles("line").alias("cut")
    sets = staged(crowd.join(texts, "id").select("id", "root", cut), "line-crowd")
    posted = sets.select("id", "root", F.explode("cut").alias("shingle"))
    parts = posted.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    common = (
        parts.groupBy("shingle")
        .agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"))
        .where("n > 1")
    )
    ordered = posted.join(common, "shingle").groupBy("id", "root").agg(
        F.sort_array(F.collect_list(F.struct("n", "shingle", "main"))).alias("all")
    )
    # those that no other line has come first and are left out
    sized = ordered.join(sets.select("id", F.size("cut").alias("size")), "id").withColumn(
        "skipped", F.col("size") - F.size("all")
    )
    prefix = "filter(all, (x, i) -> i + skipped <= size - (4 * size + 4) div 5)"
    first = staged(
        sized.select("id", "root", "size", "skipped", F.posexplode(F.expr(prefix)).alias("i", "x")).select(
            "id", "root", "size", (F.col("size") - F.col("skipped") - F.col("i")).alias("left"), "x.shingle", "x.main"
        ),
        "line-prefixes",
    )
    mixed = first.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    first = first.join(mixed.where("low != high").select("shingle"), "shingle", "left_semi")
    a, b = first.where("root != main").alias("a"), first.alias("b")
    enough = (
        "a.shingle = b.shingle AND a.root != b.root AND (b.root = b.main OR a.id < b.id)"
        " AND 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)"
        " AND if(a.size <= b.size, 9 * a.left >= 8 * a.size, 9 * b.left >= 8 * b.size)"
        " AND 9 * least(a.left, b.left) >= 4 * (a.size + b.size)"
    )
    return a.join(b, F.expr(enough)).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))


def line_links(lines: DataFrame) -> DataFrame:
    """(node, root) of the ids of all lines that are linked to another; ``lines`` is a written table."""
    shared = staged(_buckets(lines), "line-buckets")
    first = staged(
        shared.where("id != pivot")
        .groupBy(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        .agg(F.count("*").alias("bands"))
        .where("bands > 1")
        .select("a", "b"),
        "line-pairs",
    )
    members = staged(
        shared.groupBy("id").agg(F.count("*").alias("bands")).where("bands > 1").select("id"), "line-members"
    )
    texts = staged(
        lines.select("id", "line").join(if_small(members, 24), "id", "left_semi").dropDuplicates(["id"]),
        "line-texts",
    )
    links = staged(_verified(first, texts), "line-links")
    roots = components(links, "line-components")
    # what the pivots did not connect: pairs of a bucket that are still in different components
    placed = (
        shared.join(roots, F.col("id") == F.col("node"), "left")
        .select("band", "id", F.coalesce("root", "id").alias("root"))
    )
    split = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    rest = placed.join(split.where("low != high").select("band"), "band", "left_semi")
    listed = staged(
        rest.groupBy("id", "root").agg(F.sort_array(F.collect_set("band")).alias("bands")), "line-rest"
    )
    double = staged(_agreeing(listed), "line-two-bands")
    crowd = double.where(f"members > {CROWD}").select("id", "root").distinct()
    second = (
        _all_pairs(double)
        .union(_prefix_pairs(crowd, texts))
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    more = staged(_verified(second, texts), "line-more-links")
    return roots if more.isEmpty() else components(links.union(more), "line-components")


def line_classes(docs: DataFrame, place: str | None = None) -> DataFrame:
    """(place, doc_id, line_no, class_doc_id, class_line_no, kept) for every line with a word.

    class_doc_id and class_line_no name the first line of the component; it is the one that is kept.
    ``place`` numbers the rows of ``docs`` (or is its column of that name), so that rows which share a
    doc_id are told apart: of equal (doc_id, line_no) the smaller place is first. Null doc_ids come
    first. Lines without a word, null and empty texts have no row. An empty table gives an empty
    table; other columns are not read.
    """
    number = F.col(place) if place else F.monotonically_increasing_id()
    lines = staged(
        document_lines(docs.select(number.alias("place"), "doc_id", "text"), "place"), "lines"
    )
    with recorded() as scratch:
        found = line_links(lines)
    roots = staged(found, "line-roots")
    dropped(docs.sparkSession, scratch)
    known = (
        lines.select("place", "doc_id", "line_no", "id")
        .join(roots, F.col("id") == F.col("node"), "left")
        .select("place", "doc_id", "line_no", F.coalesce("root", "id").alias("root"))
    )
    first = known.groupBy("root").agg(F.min(F.struct("doc_id", "line_no", "place")).alias("first"))
    is_first = (F.col("first.place") == F.col("place")) & (F.col("first.line_no") == F.col("line_no"))
    return known.join(first, "root").select(
        "place",
        "doc_id",
        "line_no",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        is_first.alias("kept"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines taken out that are not kept; all rows and columns stay.

    Lines without a word stay. A text whose lines all go becomes empty, a null text stays null. If
    ``docs`` has a column n_chars, it becomes the length of the new text.
    """
    names = docs.columns
    place = fresh(names, "_place")
    copy = staged(docs.withColumn(place, F.monotonically_increasing_id()), "line-dedup-input")
    gone, lines, held = (fresh([*names, place], x) for x in ("_gone", "_lines", "_held"))
    taken_out = staged(
        line_classes(copy, place)
        .where("NOT kept")
        .groupBy(F.col("place").alias(place))
        .agg(F.collect_set("line_no").alias(gone)),
        "line-dedup-gone",
    )
    cut = copy.join(if_small(taken_out, 100), place, "left").withColumn(
        lines, F.when(F.col(gone).isNotNull(), F.split("text", "\n"))
    )
    cut = cut.withColumn(
        held, F.array_except(F.expr(f"sequence(0, size({lines}) - 1)"), F.col(gone))
    )
    text = F.expr(f"array_join(transform({held}, i -> {lines}[i]), '\n')")
    cut = cut.withColumn("text", F.coalesce(text, F.col("text")))
    if "n_chars" in names:
        cut = cut.withColumn(
            "n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
        )
    return cut.select(*names)
