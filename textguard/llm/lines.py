"""Removal of repeated lines across documents, near repeats included.

Lines are compared in lower case without blanks around them. Equal ones are found by a
128-bit hash. All lines are also compared by the Jaccard similarity of their shingles, the
slices of eight UTF-8 bytes at every place (a shorter line is one slice). Keys of buckets
are runs of four neighbours on the circle of a line's sorted shingle hashes. Where two
lines have a similarity of 0.8, at most one in five of all their shingles is not common, so
some run of four is: lines of up to `SHORT` shingles have a key for every run and miss no
pair among themselves. Longer ones have the runs that begin at the first hash of each of
`RANGES` ranges (a pair at similarity 0.8 shares one with odds of 0.41, and misses all of
them with odds of about one in 500; of 3,000 pairs at 0.8 each with 4 to 40, 80, 160 and 400
common shingles 0, 3, 1 and 7 were missed). Candidates whose numbers of shingles exclude the
similarity are dropped, and that of the others is computed from the whole lines.

Candidates of a bucket are not all its pairs. First every line meets the bucket's least
one; lines found similar form components. Where a bucket still holds several components,
all its lines of different ones meet if there are at most `FEW`. In larger ones every line is held
against a centre, the line with the most frequent shingles, and those of different components
meet only by rare differences from it: similar lines that are not both similar to the centre
differ from it in common (`crossing_pairs`). So every pair of a bucket that is not yet connected is
either compared or known to differ; neither a frequent passage nor a large group of near copies brings all its lines together.

One line per component stays: the first by document id, then by place. Lines without a
word stay as they are. Texts are shuffled once, to take out lines; before that only hashes
move, and the texts of candidate lines.

Null texts stay null. Rows with equal id and text count as one document and come out
alike; null ids sort first. Columns of other names come through untouched, whatever they
are called. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.durable import durable
from textguard.llm.graph import components
from textguard.llm.words import let

SHINGLE = 8
#: Shingles per key: of a pair at similarity 0.8, four in a row are always common somewhere.
RUN = 4
#: Lines of up to so many shingles have a key per shingle, longer ones one per range of hashes.
SHORT = 32
RANGES = 12
#: Up to this many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Counts of shingles are kept by this many hash slots (a byte each goes to all tasks).
SLOTS = 65_536
#: Columns of 64 bits each, by which lines that differ in too many shingles are told apart before their texts meet.
SKETCH = tuple(f"bits{k}" for k in range(8))
#: In buckets of up to so many lines all lines of different components meet.
FEW = 32
#: Lines found so often are taken from their first place alone when keys are made.
HOT = 1000


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _slices(line: Column) -> Column:
    """Hashes of all slices of eight bytes (of a shorter line: its own), in order of place, repeats included."""
    def cut(data: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(data) - (SHINGLE - 1), F.lit(1))),
                           lambda i: F.xxhash64(F.substring(data, i, F.lit(SHINGLE))))

    return let(line.cast("binary"), cut)


def shingles(line: Column) -> Column:
    """Sorted hashes of all shingles."""
    return F.sort_array(F.array_distinct(_slices(line)))


def buckets_of(lines: DataFrame) -> DataFrame:
    """id, n (number of shingles) and key of all lines, a row per key. Runs are picked from rows, so
    that this and the sorting before it are generated code."""
    def range_of(at: Column) -> Column:
        return F.shiftright((F.shiftright(F.get("s", at), 56) + 128) * RANGES, 8)

    sets = lines.select("id", shingles(F.col("line")).alias("s"))
    # The outer form, since the plain one puts a filter below, which computes the sets again.
    each = sets.select("id", "s", F.size("s").alias("n"), F.posexplode_outer("s").alias("at", "h"))
    first = (F.col("n") <= SHORT) | (F.col("at") == 0) | (range_of(F.col("at")) != range_of(F.col("at") - 1))
    run = [F.get("s", F.pmod(F.col("at") + k, "n")) for k in range(RUN)]
    return each.where(first).select("id", "n", F.xxhash64(*run).alias("key"))


def _fit(a: Column, b: Column, least: float) -> Column:
    """Whether lines of so many shingles can be similar."""
    return F.least(a, b) >= F.greatest(a, b) * least - 1e-9


def occurrences(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th (hash of the text), pos, line (normal form), id and id2 (its hash) of all lines with a word."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc", "th", "pos", _normal(F.col("line")).alias("line")).where("line != ''")
    return rows.select("*", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"))


def _need(total: Column, least: float) -> Column:
    """Common shingles of two similar lines that have `total` shingles: common / (total - common) >= least."""
    return F.ceil(total * (least / (1 + least)) - 1e-6)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of line ids with a Jaccard similarity of `least` or more; na and nb are their numbers of
    shingles. Other columns, which follow from a and b, stay."""
    pairs = pairs.where(_fit(F.col("na"), F.col("nb"), least)).distinct()
    whole = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    common = F.size(F.array_intersect(_slices(F.col("x")), _slices(F.col("y"))))
    return durable(whole.where(common >= _need(F.col("na") + F.col("nb"), least)).drop("na", "nb", "x", "y"))


def _levels(sets: DataFrame) -> Column:
    """A byte for each of `SLOTS` slots of shingle hashes: how often its shingles are found in s, by factors of about 1.4."""
    counts = sets.select(F.explode("s").alias("h")).groupBy(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).count()
    found = bytearray(SLOTS)
    for slot, level in counts.select("slot", F.floor(2 * F.log2("count")).cast("int")).collect():
        found[slot] = level
    return F.lit(bytes(found))


def _level(levels: Column, h: Column) -> Column:
    return F.substring(levels, F.pmod(h, F.lit(SLOTS)).cast("int") + 1, F.lit(1))


def spokes(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """A row for each line and centre of its `buckets` (key, id, n, root): centre, nc, rc (its number of shingles and
    root), id, n, root, s (the shingles that only one of the two has). A bucket's centre is the line whose shingles are the
    most frequent ones, which of near copies is one with few changes of its own."""
    sets = durable(texts.join(buckets.select("id").distinct(), "id").select("id", F.array_distinct(_slices(F.col("line"))).alias("s")))
    levels = _levels(sets)
    total = F.aggregate("s", F.lit(0), lambda sum_, h: sum_ + F.conv(F.hex(_level(levels, h)), 16, 10).cast("int"))
    named = buckets.join(sets.select("id", (total / F.size("s")).alias("score")), "id")
    centres = named.groupBy("key").agg(F.max(F.struct("score", "id", "n", "root")).alias("c"))
    found = named.join(centres, "key").select(
        F.col("c.id").alias("centre"), F.col("c.n").alias("nc"), F.col("c.root").alias("rc"), "id", "n", "root").distinct()
    both = found.join(sets.withColumnRenamed("s", "x"), "id").join(sets.select(F.col("id").alias("centre"), F.col("s").alias("y")), "centre")
    return durable(both.select(*found.columns, F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("s")))


def _near(least: float) -> Column:
    """Whether the line of a spoke is similar to the centre."""
    total = F.col("n") + F.col("nc")
    return F.size("s") <= total - 2 * _need(total, least)


def _bits(s: Column) -> list[Column]:
    """`SKETCH`: numbers in which each element of s turns a bit. Those of two sets differ in no more bits than the sets in elements."""
    def word(k: int) -> Column:
        own = F.filter(s, lambda h: F.pmod(F.shiftright(h, 6), F.lit(len(SKETCH))) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))))

    return [word(k).alias(name) for k, name in enumerate(SKETCH)]


def crossing_pairs(found: DataFrame, least: float = 0.8) -> DataFrame:
    """a, na, ra, b, nb, rb of all pairs of spokes with one centre and different roots that can be similar, if lines similar
    to a centre have its root.

    Where x and y differ from the centre by dx and dy shingles and may differ from each other by t, they have
    (dx + dy - t) / 2 of these differences in common. That is one at least: else both would be similar to
    the centre, and have one root. In one order, rare ones first, the first common difference comes early enough in
    both for the others to follow. So near copies of a centre do not meet by what it has in common
    with them, but by changes that few lines have; those of the centre's root do not meet one another."""
    levels = _levels(found)
    ordered = F.sort_array(F.transform("s", lambda h: F.struct(_level(levels, h).alias("level"), h.alias("h"))))
    d, share = F.size("s"), (1 - least) / (1 + least)
    # The other line is not similar to the centre if this one is, and differs from it by |n - nc| at least.
    most = F.ceil((d + F.when(_near(least), F.col("n") - F.col("nc")).otherwise(F.col("n") + F.col("nc")) * share) / 2) + 2
    first = F.transform(F.slice(ordered, F.lit(1), most.cast("int")), lambda x: x["h"])
    # Stored, since above an explode all this would be computed for each of its rows.
    sets = durable(found.select("centre", "id", "n", "root", (F.col("root") == F.col("rc")).alias("main"), d.alias("d"), *_bits(F.col("s")), first.alias("first")))
    head = sets.select("centre", "id", "n", "root", "main", "d", *SKETCH, F.posexplode("first").alias("at", "h")).withColumn("rest", F.col("d") - F.col("at"))
    roots = head.groupBy("centre", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    meeting = head.join(roots.select("centre", "h"), ["centre", "h"], "left_semi")
    x, y = meeting.where(~F.col("main")).alias("x"), meeting.alias("y")
    total = F.col("x.n") + F.col("y.n")
    spare = total - 2 * _need(total, least)
    apart = sum((F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in SKETCH), F.lit(0))
    pairs = x.join(y, (F.col("x.centre") == F.col("y.centre")) & (F.col("x.h") == F.col("y.h"))
                   & (F.col("y.main") | (F.col("x.root") < F.col("y.root"))) & _fit(F.col("x.n"), F.col("y.n"), least)
                   & (2 * F.least("x.rest", "y.rest") >= F.col("x.d") + F.col("y.d") - spare) & (apart <= spare))
    return pairs.select(*[F.col(f"{side}.{name}").alias(f"{short}{to}") for side, to in (("x", "a"), ("y", "b")) for name, short in (
        ("id", ""), ("n", "n"), ("root", "r"))]).distinct()


def _moved(rows: DataFrame, moves: DataFrame, name: str = "root") -> DataFrame:
    """`rows` with the new roots of `moves` (id, root)."""
    to = moves.select(F.col("id").alias(name), F.col("root").alias("new"))
    return rows.join(to, name, "left").withColumn(name, F.coalesce("new", name)).drop("new").select(rows.columns)


def line_classes(lines: DataFrame, least: float = 0.8) -> DataFrame:
    """id and root (least id) of all lines that are similar to another one."""
    bucket = Window.partitionBy("key")
    shared = buckets_of(lines).withColumn("first", F.min("id").over(bucket)).withColumn("last", F.max("id").over(bucket))
    shared = durable(shared.where("first != last").select("key", "id", "n", "first").distinct())
    needed = durable(shared.select("id", "n").distinct())
    ids = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    texts = durable(lines.join(ids, "id").groupBy("id", "n").agg(F.min("line").alias("line")))
    stars = _verified(shared.where("id != first").join(needed.select(F.col("id").alias("first"), F.col("n").alias("na")), "first").select(
        F.col("first").alias("a"), "na", F.col("id").alias("b"), F.col("n").alias("nb")), texts, least)
    classes = durable(components(stars))
    # Buckets that still hold several components: in small ones all lines meet, in larger ones a centre, then those with common rare differences from it.
    named = shared.join(classes, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    sizes = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo != hi")
    mixed = durable(named.join(sizes.select("key", "size"), "key"))
    found = spokes(mixed.where(F.col("size") > FEW).drop("size"), texts)
    hubs = durable(found.where((F.col("root") != F.col("rc")) & _near(least)).select(F.col("rc").alias("ra"), F.col("root").alias("rb")).distinct())
    moves = durable(components(hubs, "ra", "rb"))
    few = _moved(mixed.where(F.col("size") <= FEW), moves)
    few = few.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra")).join(
        few.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb")), "key").where("ra < rb").drop("key")
    more = _verified(few.unionByName(crossing_pairs(_moved(_moved(found, moves), moves, "rc"), least)), texts, least)
    edges = hubs.unionByName(more.select("ra", "rb"))
    if edges.isEmpty():
        return classes
    moves = durable(components(edges, "ra", "rb"))
    return _moved(classes, moves).unionByName(moves.join(classes, "id", "left_anti"))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """All columns of `docs` in a struct `row`, and text (with one line per component over all
    documents), n_lines, n_removed."""
    lines = occurrences(docs, doc, text)
    place = F.struct("doc", "th", "pos")
    # Lines by exact hash first, so that a line with a third of all occurrences shrinks before any join.
    exact = durable(lines.groupBy("id", "id2").agg(F.min(place).alias("first"), F.count("*").alias("times")))
    hot = exact.where(F.col("times") >= HOT).select("id", "first")
    once = lines.join(F.broadcast(hot), "id", "left").where(F.col("first").isNull() | F.col("first").eqNullSafe(place)).drop("first")
    classes = line_classes(once, least)
    exact = exact.drop("times")
    kept = durable(exact.join(classes, "id", "left").withColumn(
        "same", F.when(F.col("root").isNull(), F.struct("id", "id2")).otherwise(
            F.struct(F.col("root").alias("id"), F.lit(0).cast("long").alias("id2")))).groupBy("same").agg(F.min("first").alias("first")))
    by_doc = kept.groupBy(F.col("first.doc").alias("doc"), F.col("first.th").alias("th")).agg(
        F.collect_list("first.pos").alias("kept"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    joined = rows.alias("r").join(by_doc.alias("k"), F.col("r.doc").eqNullSafe(F.col("k.doc")) & (F.col("r.th") == F.col("k.th")), "left")
    rebuilt = joined.select("row", "r.text", F.when(F.col("text").isNotNull(), let(F.split("r.text", "\n", -1), lambda x: F.struct(
        F.size(x).alias("n"), _staying(x, F.coalesce("kept", F.array().cast("array<int>"))).alias("left")))).alias("lines"))
    return rebuilt.select(
        "row", F.array_join("lines.left", "\n").alias("text"), F.coalesce("lines.n", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col("lines.n") - F.size("lines.left"), F.lit(0)).cast("long").alias("n_removed"))


def _staying(lines: Column, kept: Column) -> Column:
    """Lines without a word, and those whose place is among `kept`: places and marks are
    sorted together, so a text of any length takes n log n steps."""
    own = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("pos"), F.lit(0).alias("mark"), x.alias("line")))
    marks = F.transform(kept, lambda p: F.struct(p.alias("pos"), F.lit(1).alias("mark"), F.lit(None).cast("string").alias("line")))

    def chosen(both: Column) -> Column:
        after = F.concat(F.slice(both, 2, F.size(both)), F.array(F.lit(None).cast("struct<pos:int,mark:int,line:string>")))
        stay = F.zip_with(both, after, lambda x, y: F.when((x["mark"] == 0) & (
            (_normal(x["line"]) == "") | F.coalesce((y["pos"] == x["pos"]) & (y["mark"] == 1), F.lit(False))), x["line"]))
        return F.filter(stay, lambda x: x.isNotNull())

    return let(F.sort_array(F.concat(own, marks)), chosen)
