"""URL rules by a cascade of Bloom filters, in DataFrame operations alone.

The keys of a URL are its host's last labels joined with the first characters of its path, in the shapes that the
listed keys have.  The first filter encodes the listed keys.  All keys of the corpus that aren't listed are put to it;
those it takes for listed make the second filter, the listed keys that the second takes for those make the third, and
so on until a level takes nothing for what it isn't.  For every key of the corpus the first level that turns it away
then tells exactly whether it is listed, so URLs are judged from one array of bits without a join.  A second cascade,
whose universe is the list itself, tells blocked keys from allowed ones.

A filter's bits lie in words of 64: a key sets BITS bits of one word, so a test reads one word a level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Words of all levels together that are handed to the tasks as one array (8 MB); beyond it, listed keys are joined.
MAX_WORDS = 1 << 20
#: Shapes (labels of the host, characters of the path) that are tested one by one; beyond it, listed keys are joined.
MAX_SHAPES = 48
#: Listed keys that are broadcast while the cascade is built; beyond it the join is by shuffle.
BROADCAST_ROWS = 200_000
#: Bits that a key sets in its word.
BITS = 5

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Level:
    seed: int
    start: int
    words: int


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_AZ)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_keys(rules: DataFrame) -> DataFrame:
    """key, verdict, labels, chars of every rule that can fit a URL, one row a key; a key listed both ways is blocked."""
    host = F.translate(F.col("host"), *_AZ)
    path = F.coalesce(F.col("path"), F.lit(""))
    able = F.col("verdict").isin("allow", "block") & (host != "") & ~host.rlike("[/?#]") & ((path == "") | path.startswith("/")) & ~path.rlike("[?#]")
    keyed = rules.filter(able).select(F.concat(host, path).alias("key"), "verdict", F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("chars"))
    return keyed.groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("labels").alias("labels"), F.max("chars").alias("chars"))


def _key(labels: int, chars: int) -> Column:
    """The key of one shape, null where host or path are too short for it."""
    dots = F.length("host") - F.length(F.translate(F.col("host"), ".", ""))
    fits = (F.col("host") != "") & (dots >= labels - 1) & (F.length("path") >= chars)
    return F.when(fits, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))


def _word_and_bits(key: Column, level: Level) -> tuple[Column, Column]:
    spread = F.xxhash64(F.lit(2 * level.seed + 1), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    return F.pmod(F.xxhash64(F.lit(2 * level.seed), key), F.lit(level.words)).cast("int"), reduce(lambda a, b: a.bitwiseOR(b), bits)


def _takes(key: Column, level: Level, array: DataFrame, start: int) -> Column:
    word, bits = _word_and_bits(key, level)
    return array.scalar()[word + F.lit(start)].bitwiseAND(bits) == bits


def _filter_words(keys: DataFrame, level: Level) -> DataFrame:
    word, bits = _word_and_bits(F.col("key"), level)
    return keys.select((word + F.lit(level.start)).alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _as_array(words: DataFrame, size: int) -> DataFrame:
    """One row with one array of `size` words (bounded by MAX_WORDS); words that no key has are 0."""
    spark = words.sparkSession
    every = spark.range(size).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = every.unionByName(words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


@dataclass(frozen=True)
class Cascade:
    """Levels of one cascade; their words lie in one table together with those of other cascades."""

    levels: list[Level]

    def holds(self, key: Column, array: DataFrame) -> Column:
        """Whether a key of the universe is listed: the first level that turns it away decides, odd ones for yes."""
        told = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            told = F.when(_takes(key, self.levels[i], array, self.levels[i].start), told).otherwise(F.lit(i % 2 == 1))
        return told


def build_cascade(listed: DataFrame, others: DataFrame, start: int = 0, bits_per_key: float = 16.0) -> tuple[Cascade, DataFrame | None]:
    """The cascade that tells the keys `listed` from the keys `others` (one column key each, none in both), and its words.

    The first level has more bits the more other keys there are for each listed one, so that about as many are taken
    wrongly as are listed; the others have `bits_per_key` (4 at least).  Only counts reach the driver.  The words are None where the
    levels would need more than MAX_WORDS.
    """
    inside, outside, levels, tables = listed, others, [], []
    n_in, n_out = listed.count(), others.count()
    while n_in:
        bits = max(bits_per_key, 4.0) + (8 * max(0, (n_out // n_in).bit_length() - 4) if not levels else 0)
        level = Level(len(levels) + 1 + 64 * (start > 0), start, max(1, int(n_in * bits / 64)))
        if level.start + level.words > MAX_WORDS:
            return Cascade(levels), None
        tables.append(materialise(_filter_words(inside, level)))
        levels.append(level)
        start += level.words
        alone = tables[-1].select((F.col("word") - F.lit(level.start)).alias("word"), "bits")
        wrong = materialise(outside.filter(_takes(F.col("key"), level, _as_array(alone, level.words), 0)).select("key"))
        inside, outside, n_in = wrong, inside, wrong.count()
    return Cascade(levels), reduce(DataFrame.unionByName, tables) if tables else None


def _by_join(split: DataFrame, listed: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """The same result for lists beyond the bounds: candidate keys of each different host and path meet the list by a shuffle."""
    places = split.select("host", "path").distinct()
    n_labels = F.length("host") - F.length(F.translate(F.col("host"), ".", "")) + 1
    fitting = F.filter(F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes]), lambda s: (s["labels"] <= n_labels) & (s["chars"] <= F.length("path")))
    keyed = places.filter("host <> ''").select("host", "path", F.explode(fitting).alias("s")).select("host", "path", "s", F.concat(F.expr("substring_index(host, '.', -s.labels)"), F.expr("substring(path, 1, s.chars)")).alias("key"))
    best = keyed.join(listed.select("key", "verdict"), "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), F.col("s.labels"))).alias("best"))
    found = split.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", bits_per_key: float = 16.0) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `df`.

    `rules` has the columns host, path and verdict (block or allow).  A rule fits its host and all subdomains where the
    URL's path starts with the rule's; of those that fit, the one of most characters is taken, of equally long ones that with more
    labels.  A URL that no listed key fits is allowed, with a null rule.  Rules that can fit no URL (an empty host, a path
    without leading slash, another verdict) are passed over; a key that is listed to be blocked and allowed is blocked.

    A null URL and one without :// have an empty host and path, and nothing fits them.  Repeated rows are judged alike,
    a null id stays null, URLs of any length are read whole, an empty table gives no rows, no rules allow everything.
    Other columns are ignored.
    """
    split = df.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    listed = materialise(listed_keys(rules))
    # At most (longest rule's labels) x (longest rule's path) of them.
    shapes = sorted({(r.labels, r.chars) for r in listed.select("labels", "chars").distinct().collect()}, key=lambda s: (-s[1], -s[0]))
    nothing = split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    if not shapes:
        return nothing
    if len(shapes) > MAX_SHAPES:
        return _by_join(split, listed, shapes)
    few = listed.count() <= BROADCAST_ROWS
    keys = split.select(F.explode(F.array(*[_key(*s) for s in shapes])).alias("key")).filter("key is not null").distinct()
    unlisted = materialise(keys.join(F.broadcast(listed) if few else listed, "key", "left_anti").select("key"))
    member, words = build_cascade(listed.select("key"), unlisted, 0, bits_per_key)
    blocked, more = build_cascade(listed.filter("verdict = 'block'").select("key"), listed.filter("verdict = 'allow'").select("key"), sum(x.words for x in member.levels), bits_per_key)
    if words is None or (blocked.levels and more is None):
        return _by_join(split, listed, shapes)
    words = words.unionByName(more) if more is not None else words
    array = materialise(_as_array(words, sum(x.words for x in [*member.levels, *blocked.levels])))
    # One column a shape, each decided once; then the longest key, of equally long ones that with more labels.
    tried = split.select("*", *[_key(*s).alias(f"key{i}") for i, s in enumerate(shapes)])
    found = tried.select("page_id", "host", "path", *[F.when(member.holds(F.col(f"key{i}"), array), F.struct(F.length(f"key{i}").alias("n"), F.lit(s[0]).alias("labels"), F.col(f"key{i}").alias("key"))).alias(f"found{i}") for i, s in enumerate(shapes)])
    with_rule = found.select("page_id", "host", "path", F.array_max(F.array(*[F.col(f"found{i}") for i in range(len(shapes))]))["key"].alias("rule"))
    verdict = F.when(F.col("rule").isNull() | ~blocked.holds(F.col("rule"), array), F.lit("allow")).otherwise(F.lit("block"))
    return with_rule.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
