"""Line dedup: an exact set-similarity self-join of all lines, in DataFrame functions only.

A line is the set of its lower-cased, white-space separated words. A line goes
where an earlier one (by doc_id, version, then line number) has a Jaccard
similarity of ``threshold`` or more with it, whether or not that earlier line
itself stays. Rows that share a doc_id, or have none, are told apart by a row
number, the version; it is 0 for a doc_id that has one row only.

Texts are split once; each line is kept as 31 bits of each of its words. They
are ordered by rarity: by the count of their bucket over all different lines (a
table of fixed size, handed over as a scalar subquery), then by value. Under any
such order two similar sets of n <= m words share a word among the shorter one's
first n - ceil(2t/(1+t) n) + 1 and the longer one's first m - ceil(t m) + 1, and
at the first of them the rest of both sets must still allow the overlap needed;
lengths must fit; and the parity bits of two sets (64, for longer lines 128, 256
or 512) cannot differ in more places than the sets do. Words whose 31 bits are
equal stay apart in a line, so they can only add pairs. What passes these
filters is verified on the whole sets of 64-bit hashes, from the texts.

Lines of equal sets form one class, represented by the earliest, so copies of
a line cost one row each. The posting lists of some words of a line first
meet only their earliest members; only lines that are left undecided meet all
earlier members, so most of a group of near copies is not paired with itself.

Defined results: a line without words always stays. A null text has no lines
and stays null. Rows under one doc_id, or without one, are judged each by
itself, in the order of their texts' hashes, so of exactly repeated rows the
first keeps its lines and the others lose theirs. A null doc_id comes first.
Texts and lines of any length are read whole. An empty table gives no rows.
Extra columns stay, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import fresh, materialize
from chalkline.llm.shards import row_versions

THRESHOLD = 0.8
#: Hash buckets whose counts order the words, in rows of so many.
BUCKETS, BUCKET_ROW = 1 << 19, 1 << 10
#: Beside the 64 parity bits of every line, lines of so many words have the half of 128 bits whose fold these 64 are.
HALF_WORDS = 40
#: Lines of so many words have two of the four longs of 256 bits whose fold those 128 are.
QUARTER_WORDS = 160
#: Lines of so many words have 512 bits too, as eight longs.
WIDE_WORDS, WIDTH = 400, 8
PARITY = ["parity", "half", "third", "fourth", "wide"]
#: Words of a line's prefix, evenly from the rarest to the last (edits of a near copy are mostly rare words), and for each
#: of them so many of its posting list's earliest members, which the line meets first.
STAR_WORDS, STAR_MEMBERS = 4, 4
#: Ids of at most this many rows (16 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

NULL_ID = -(1 << 63)
#: What a line is known by, in the order of lines: document, version of its text, number.
KEY = ["d", "v", "line"]
#: Bits of a word's hash in its line's row and the posting lists; a rarity class lies above them.
WORD_BITS, HASH_BITS = 31, 56


def doc_key(doc_id: str | Column) -> Column:
    return F.coalesce(F.col(doc_id).cast("long") if isinstance(doc_id, str) else doc_id, F.lit(NULL_ID).cast("long"))


def normal(text: Column) -> Column:
    """Lower-cased text whose only separators are spaces and line ends."""
    text = F.lower(text)
    for c in "\t\r\f\v":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit(BUCKETS - 1))


def rarity_classes(lines: DataFrame) -> Column:
    """An array, as a scalar subquery: for each bucket of ``words`` twice the binary logarithm of its count, at most 127, in
    the top bits of a long. The one row it comes from has BUCKETS entries whatever the input."""
    # every bucket counts one more, so that none is left out
    every = lines.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    counts = (lines.select(F.explode("words").alias("w")).select(bucket(F.col("w")).alias("b")).unionByName(every)
              .groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    entry = F.struct("b", F.least(F.floor(2 * F.log2("n")), F.lit(127)).cast("long").alias("c"))
    rows = counts.groupBy(F.floor(F.col("b") / BUCKET_ROW).alias("r")).agg(F.sort_array(F.collect_list(entry)).alias("x"))
    rows = rows.select("r", F.transform("x.c", lambda c: F.shiftleft(c, HASH_BITS)).alias("x"))
    classes = rows.agg(F.sort_array(F.collect_list(F.struct("r", "x"))).alias("x"))
    return materialize(classes.select(F.flatten("x.x").alias("classes"))).scalar()


def word_of(ranked: str) -> Column:
    """The word below its rarity class."""
    return F.col(ranked).bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int").alias("w")


def with_sets(lines: DataFrame) -> DataFrame:
    """``lines`` with ``s`` for ``body``: the sorted hashes of its distinct words."""
    hashes = F.transform(F.split("body", " "), lambda w: F.xxhash64(w))
    return lines.select(*KEY, F.sort_array(F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))).alias("s"))


def lines_of(docs: DataFrame) -> DataFrame:
    """``d, v, line, body`` of every line of versioned rows, in normal form."""
    return docs.select(doc_key("doc_id").alias("d"), "v", F.posexplode(F.split(normal(F.col("text")), "\n")).alias("line", "body"))


def parities(n: Column) -> list[Column]:
    """Parity bits of ``words``: word x flips bit x mod 64; in the wider forms, of the long (x div 64) mod width."""
    def one(width: int, k: int) -> Column:
        def flip(bits: Column, x: Column) -> Column:
            flipped = bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x))      # a shift takes x mod 64
            return flipped if width == 1 else F.when(x.bitwiseAND(F.lit((width - 1) << 6)) == k << 6, flipped).otherwise(bits)
        return F.aggregate("words", F.lit(0).cast("long"), flip)

    none = F.lit(0).cast("long")
    return [one(1, 0).alias("parity"), F.when(n >= HALF_WORDS, one(2, 1)).otherwise(none).alias("half"),
            F.when(n >= QUARTER_WORDS, one(4, 2)).otherwise(none).alias("third"),
            F.when(n >= QUARTER_WORDS, one(4, 3)).otherwise(none).alias("fourth"),
            F.when(n >= WIDE_WORDS, F.array(*[one(WIDTH, k) for k in range(WIDTH)])).alias("wide")]


def _narrow(a: dict[str, Column], b: dict[str, Column], least: Column) -> Column:
    """Of 64 parity bits, or 128 or 256 where the shorter set has so many, those in which two sets differ (of the 128 bits
    the upper half is kept, of the 256 the last two longs; what is left out is their difference from the fold)."""
    fold, upper, third, fourth = (a[c].bitwiseXOR(b[c]) for c in PARITY[:4])
    return (F.when(least < HALF_WORDS, F.bit_count(fold))
            .when(least < QUARTER_WORDS, F.bit_count(upper) + F.bit_count(upper.bitwiseXOR(fold)))
            .otherwise(F.bit_count(third) + F.bit_count(fourth) + F.bit_count(upper.bitwiseXOR(fourth))
                       + F.bit_count(upper.bitwiseXOR(fold).bitwiseXOR(third))))


def _off(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Parity bits in which two sets differ, at the width of the shorter one."""
    least = F.least(_words(a), _words(b))
    wide = F.aggregate(F.zip_with(a["wide"], b["wide"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    return F.when(least < WIDE_WORDS, _narrow(a, b, least)).otherwise(wide)


#: A posting row: document, version, line, number of words and place of the word (packed), parity bits.
def _packed(n: Column, at: Column) -> Column:
    return F.shiftleft(n.cast("long"), 32).bitwiseOR(at.cast("long"))


def _words(x: dict[str, Column]) -> Column:
    return F.shiftright(x["size"], 32)


def _earlier(a: dict[str, Column], b: dict[str, Column]) -> Column:
    same = a["d"] == b["d"]
    return (a["d"] < b["d"]) | (same & (a["v"] < b["v"])) | (same & (a["v"] == b["v"]) & (a["line"] < b["line"]))


def _near(a: dict[str, Column], b: dict[str, Column], off: Column, t: Fraction) -> Column:
    """Whether sets that differ in ``off`` parity bits can have the overlap needed, t / (1 + t) of both lengths."""
    total = _words(a) + _words(b)
    return 2 * total * t.numerator <= (total - off) * (t.numerator + t.denominator)


def _fits(a: dict[str, Column], b: dict[str, Column], t: Fraction) -> Column:
    """Whether the length, positional and narrow parity filters let two posting rows pass. No array function is asked here,
    so that Spark compiles the join as a whole."""
    n, m = _words(a), _words(b)
    low = F.lit((1 << 32) - 1)
    length = (n * t.denominator >= m * t.numerator) & (m * t.denominator >= n * t.numerator)
    rest = F.least(n - a["size"].bitwiseAND(low), m - b["size"].bitwiseAND(low))
    enough = rest * (t.numerator + t.denominator) >= (n + m) * t.numerator
    return length & enough & _near(a, b, _narrow(a, b, F.least(n, m)), t)


def star_words(prefix: Column) -> Column:
    last = F.size(prefix) - 1
    return F.array_distinct(F.array(*[F.get(prefix, F.floor(last * k / F.lit(STAR_WORDS - 1)).cast("int")) for k in range(STAR_WORDS)]))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast where its counted rows (of ids) are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``d, v, line, s`` of the lines that ``pairs`` (ad, av, aline, bd, bv, bline) name."""
    ends = pairs.select(F.explode(F.array(*[F.struct(*[F.col(side + c).alias(c) for c in KEY]) for side in "ab"])).alias("x"))
    ids = materialize(ends.select("x.*").distinct())
    in_docs = _small(materialize(ids.select(F.col("d").alias("id")).distinct()))
    own = docs.join(in_docs, doc_key(docs["doc_id"]) == in_docs["id"], "left_semi")
    return materialize(with_sets(lines_of(own).join(_small(ids), KEY)))


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """``d, v, line`` of the later lines of ``pairs`` that are similar indeed."""
    both = pairs
    for side in "ab":
        both = both.join(sets.select(*[F.col(c).alias(side + c) for c in KEY], F.col("s").alias("s" + side)), [side + c for c in KEY])
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return (both.filter(shared * t.denominator >= union * t.numerator)
            .select(*[F.col("b" + c).alias(c) for c in KEY]).distinct())


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``d, v, line``: numbers of the lines that go (d is the doc_id, the smallest long where it is null; v the version)."""
    return _removed(row_versions(docs.select("doc_id", "text"), "v"), threshold)


def _removed(docs: DataFrame, threshold: float) -> DataFrame:
    t = Fraction(str(threshold)).limit_denominator(1000)
    # a normal line has words where anything but spaces is left
    sets = with_sets(lines_of(docs).filter(F.trim("body") != ""))
    rows = sets.select(*KEY, F.xxhash64("s").alias("set"), F.size("s").alias("n"),
                       F.transform("s", lambda x: F.shiftrightunsigned(x, 64 - WORD_BITS).cast("int")).alias("words"))
    # one row per class of equal sets; the others go
    member = Window.partitionBy("set", "n").orderBy(*KEY)
    ranked = rows.withColumn("copy", F.row_number().over(member))
    ranked = materialize(ranked.select(*KEY, "n", F.when(F.col("copy") == 1, F.col("words")).alias("words")))
    n = F.col("n")
    # no null may come of it, as only such arrays are sorted as plain longs
    order = F.transform("words", lambda x: F.coalesce(F.get(F.col("classes"), bucket(x)), F.lit(0).cast("long")).bitwiseOR(x))
    prefix = n + F.floor(-(n * t.numerator) / F.lit(t.denominator)).cast("int") + 1
    judged = materialize(ranked.withColumn("classes", rarity_classes(ranked)).select(
        *KEY, "n", *parities(n), F.slice(F.sort_array(order), 1, prefix).alias("prefix")))
    del ranked                                  # the words of all lines may leave the checkpoint folder
    copies = judged.filter("prefix IS NULL").select(*KEY)
    own = judged.filter("prefix IS NOT NULL")

    def side(name: str) -> dict[str, Column]:
        return {c: F.col(name + c) for c in (*KEY, "size", *PARITY)}

    def ends(earlier: dict[str, Column], later: dict[str, Column]) -> list[Column]:
        return [x[c].alias(name + c) for name, x in (("a", earlier), ("b", later)) for c in KEY]

    # words of the posting lists are 31 bits: what meets by chance fails the verification
    # (the place of a star's word is left out: it bounds the overlap only at the first word that two sets share)
    a, b = side("a."), side("b.")
    earliest = Window.partitionBy("w").orderBy(*KEY)
    listed = (own.select(F.explode(star_words(F.col("prefix"))).alias("x"), *KEY, "n", *PARITY)
              .select(word_of("x"), *KEY, _packed(F.col("n"), F.lit(0)).alias("size"), *PARITY).repartition("w"))
    heads = listed.withColumn("place", F.row_number().over(earliest)).filter(F.col("place") <= STAR_MEMBERS)
    led = heads.alias("a").join(listed.alias("b"), (F.col("a.w") == F.col("b.w")) & _earlier(a, b) & _fits(a, b, t))
    starred = materialize(_met(led, a, b, ends(a, b), t).drop("off"))
    gone = materialize(_verified(starred, _sets(starred, docs), t))
    # only what is left undecided meets every earlier member
    decided = _small(gone.select(*[F.col(c).alias("g" + c) for c in KEY]))
    marked = own.join(decided, (F.col("d") == F.col("gd")) & (F.col("v") == F.col("gv")) & (F.col("line") == F.col("gline")), "left")
    posting = (marked.select(F.posexplode("prefix").alias("at", "x"), *KEY, F.col("gd").isNull().alias("open"), "n", *PARITY)
               .select(word_of("x"), *KEY, "open", _packed(F.col("n"), F.col("at")).alias("size"), *PARITY).repartition("w"))
    # the shorter of two lines (of equally long ones the earlier) is found by fewer words than the longer
    # (asked together with the partition, or Spark would ask it before the exchange and deal these rows a second time)
    size, place = F.shiftright("size", 32), F.col("size").bitwiseAND(F.lit((1 << 32) - 1))
    few = (size - place) * (t.numerator + t.denominator) >= 2 * size * t.numerator
    first = posting.filter(F.when(F.spark_partition_id() >= 0, few))
    before = _earlier(a, b)
    undecided = F.when(before, F.col("b.open")).otherwise(F.col("a.open") & (_words(a) < _words(b)))
    met = first.alias("a").join(posting.alias("b"), (F.col("a.w") == F.col("b.w")) & (_words(a) <= _words(b)) & _fits(a, b, t) & undecided)
    sorted_ends = ends(*[{c: F.when(before, x[c]).otherwise(y[c]) for c in KEY} for x, y in ((a, b), (b, a))])
    rest = materialize(_met(met, a, b, sorted_ends, t))
    sets = _sets(rest, docs)
    # one similar line is enough: the nearest by parity first, and every other one for the lines it does not decide
    later = ["b" + c for c in KEY]
    nearest = materialize(rest.groupBy(*later).agg(F.min(F.struct("off", "ad", "av", "aline")).alias("x")).select("x.*", *later))
    near = materialize(_verified(nearest.drop("off"), sets, t))
    others = rest.join(near.select(*[F.col(c).alias("b" + c) for c in KEY]), later, "left_anti").drop("off")
    return copies.unionByName(gone).unionByName(near).unionByName(_verified(others, sets, t)).distinct()


def _met(joined: DataFrame, a: dict[str, Column], b: dict[str, Column], ends: list[Column], t: Fraction) -> DataFrame:
    """The different pairs of a join of posting rows, with the parity bits they are off, once the widest bits let them pass.

    The widest bits are asked of the pairs' groups, as Spark would move a filter of rows into the join.
    """
    off = _off(a, b)
    pairs = joined.select(*ends, off.alias("off"), _near(a, b, off, t).alias("near"))
    names = [side + c for side in "ab" for c in KEY]
    return pairs.groupBy(*names).agg(F.min("off").alias("off"), F.bool_or("near").alias("near")).filter("near").drop("near")


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, lines: str = "lines", removed: str = "removed_lines") -> DataFrame:
    """``docs`` with its texts' remaining lines, and how many lines each text had and lost."""
    d, v, own, at, body = (fresh(docs, c) for c in ("d", "v", "version", "gone", "body"))
    docs = row_versions(docs, own)
    gone = _removed(docs.select("doc_id", "text", F.col(own).alias("v")), threshold)
    gone = materialize(gone.groupBy("d", "v").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    gone = gone.select(F.col("d").alias(d), F.col("v").alias(v), F.col("gone").alias(at))
    joined = docs.join(_small(gone), (doc_key("doc_id") == F.col(d)) & (F.col(own) == F.col(v)), "left").withColumn(body, F.split("text", "\n"))
    total = F.size(body)
    numbers = F.sequence(F.lit(0), total - 1)
    kept = F.array_except(numbers, F.coalesce(F.col(at), F.array().cast("array<int>")))
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(body), i)), "\n"))
    return joined.withColumns({
        lines: F.coalesce(F.when(F.col("text").isNotNull(), total), F.lit(0)),
        removed: F.when(F.col("text").isNull(), 0).otherwise(total - F.size(kept)), "text": text}).drop(d, v, own, at, body)
