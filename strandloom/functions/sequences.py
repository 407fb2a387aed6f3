"""Column expressions on sequences (strings over ACGT), paths (strings over =XID) and edits (position, slot).

In a path I consumes a base of the query, D one of the reference, = and X one of each.  Everything here stays in
Catalyst; a null argument gives a null result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: Stand-in for the log of zero, and the probability up to which a log counts as that.
LOG_ZERO = -1e31
SMALLEST = 1e-8


@dataclass(frozen=True)
class Layout:
    """Slots of a table of edit scores: 4 substitutions, 4 insertions before the position, copies, deletions."""

    copies: int
    deletions: int

    @property
    def slots(self) -> int:
        return 8 + self.copies + self.deletions


T9, T14, T16 = Layout(0, 1), Layout(3, 3), Layout(4, 4)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def clean(seq: Column) -> Column:
    """Upper case, without anything but bases."""
    return F.upper(F.regexp_replace(seq, "[^ACGTacgt]", ""))


def base_index(base: Column) -> Column:
    """0 to 3; anything that isn't a base counts as A."""
    return F.greatest(F.instr(F.lit(BASES), F.upper(base)) - 1, F.lit(0))


def flip(path: Column) -> Column:
    """The path with reference and query exchanged."""
    return F.translate(path, "ID", "DI")


def reference_length(path: Column) -> Column:
    return F.length(F.translate(path, "I", "")).cast("long")


def query_length(path: Column) -> Column:
    return F.length(F.translate(path, "D", "")).cast("long")


def nonmatches(path: Column) -> Column:
    return F.length(F.translate(path, "=", "")).cast("long")


def clamped_log(x: Column) -> Column:
    return F.when(x > SMALLEST, F.ln(x)).otherwise(F.lit(LOG_ZERO))


def log_sum_exp(values: Column, empty: float = 0.0) -> Column:
    """Of an array of doubles; `empty` for an empty one (LOG_ZERO where a sum of nothing is to be impossible)."""
    top = F.array_max(values)
    return F.when(F.size(values) == 0, F.lit(float(empty))).otherwise(top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def cigar_path(cigar: Column) -> Column:
    """CIGAR to path: M, =, X are matches, I and clips insertions, D deletions; null where N or P occur."""
    step = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), 0)
    path = F.array_join(F.transform(step, lambda s: F.repeat(F.translate(F.substring(s, -1, 1), "M=XISHD", "===IIID"), F.regexp_extract(s, "[0-9]+", 0).cast("int"))), "")
    return F.when(cigar.rlike("[NP]"), F.lit(None).cast("string")).otherwise(path)


def three_way(reference: Column, query: Column, path: Column) -> Column:
    """struct(ref, mid, query): the rows of an alignment; mid has | for equal bases, X for others, blanks at gaps.

    Each base brings the gaps before it, so nothing is folded and the work is linear; null arguments give a struct of nulls.
    """
    known = reference.isNotNull() & query.isNotNull() & path.isNotNull()

    def gapped(sequence: Column, gap: str) -> Column:
        pieces = F.regexp_extract_all(path, F.lit(f"{gap}*[^{gap}]|{gap}+$"), 0)
        bases = _letters(sequence)
        return F.array_join(F.transform(pieces, lambda c, j: F.when(F.endswith(c, F.lit(gap)), F.repeat(F.lit(" "), F.length(c))).otherwise(F.concat(F.repeat(F.lit(" "), F.length(c) - 1), F.get(bases, j)))), "")

    rows = F.struct(gapped(reference, "I").alias("ref"), gapped(query, "D").alias("query"))

    def told(s: Column) -> Column:
        columns = F.arrays_zip(_letters(path).alias("op"), F.split(s["ref"], "").alias("r"), F.split(s["query"], "").alias("q"))
        mid = F.transform(F.slice(columns, 1, F.length(path)), lambda c: F.when(c["op"].isin("I", "D"), " ").when(c["r"] == c["q"], "|").otherwise("X"))
        return F.struct(s["ref"].alias("ref"), F.array_join(mid, "").alias("mid"), s["query"].alias("query"))

    none = F.lit(None).cast("string")
    return F.when(known, F.transform(F.array(rows), told)[0]).otherwise(F.struct(none.alias("ref"), none.alias("mid"), none.alias("query")))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def path_runs(path: Column) -> Column:
    """The runs of a path: an array of strings of one letter each."""
    return F.regexp_extract_all(path, F.lit("=+|X+|I+|D+"), 0)


def crop(runs: Column, start: Column, begin: Column, end: Column) -> Column:
    """struct(path_from, path_to, query_from, query_to): what of an alignment lies on the reference from `begin` to before `end`.

    `runs` (see `path_runs`) begin at reference position `start`.  The four are half-open ranges of the path and the query, null
    and 0 where no reference base lies there.  Query bases inserted before the first reference base of the range, and those
    after its last one, are left out.  A fold over runs whose state is six numbers, whatever the length of the path.
    """
    names = ["p", "r", "q", "path_from", "path_to", "query_from", "query_to"]
    none = F.lit(None).cast("int")
    first = F.struct(F.lit(0).alias("p"), start.cast("int").alias("r"), F.lit(0).alias("q"), none.alias("path_from"), F.lit(0).alias("path_to"), none.alias("query_from"), F.lit(0).alias("query_to"))

    def step(s: Column, run: Column) -> Column:
        n, op = F.length(run), F.substring(run, 1, 1)
        on_r, on_q = F.when(op == "I", 0).otherwise(n), F.when(op == "D", 0).otherwise(n)
        open_ = s["r"] < end
        begins = s["path_from"].isNull() & open_ & (op != "I") & (s["r"] + n > begin)
        skip = F.greatest(begin - s["r"], F.lit(0))
        take = F.when(op == "I", n).otherwise(F.least(n, end - s["r"]))
        inside = open_ & (begins | s["path_from"].isNotNull())
        values = [
            s["p"] + n, s["r"] + on_r, s["q"] + on_q,
            F.when(begins, s["p"] + skip).otherwise(s["path_from"]), F.when(inside, s["p"] + take).otherwise(s["path_to"]),
            F.when(begins, s["q"] + F.when(op == "D", 0).otherwise(skip)).otherwise(s["query_from"]), F.when(inside, s["q"] + F.when(op == "D", 0).otherwise(take)).otherwise(s["query_to"]),
        ]
        return F.struct(*[v.cast("int").alias(c) for v, c in zip(values, names, strict=True)])

    return F.aggregate(runs, first, step, lambda s: F.struct(*[s[c].alias(c) for c in names[3:]]))


def path_columns(path: Column) -> Column:
    """A path as an array of strings by reference base: insertions before it and its own step; the last may be insertions only."""
    return F.regexp_extract_all(path, F.lit("I*[=XD]|I+$"), 0)


def lifted(columns: Column, edits: Column, layout: Layout) -> Column:
    """The path after edits (an array of struct(pos, slot) sorted by pos, none on another's bases) of its reference.

    `columns` is the path by `path_columns`.  New bases become deletions right behind the base before them, deleted bases'
    steps insertions.  What lies between two edits is copied as one piece.
    """
    copies = 8 + layout.copies
    gone = lambda e: F.when(e["slot"] >= copies, e["slot"] - copies + 1).otherwise(F.lit(0))
    joined = lambda a, n: F.array_join(F.slice(columns, (a + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")), "")

    def piece(e: Column, i: Column) -> Column:
        before = F.get(edits, i - 1)
        at = F.coalesce(before["pos"] + gone(before), F.lit(0))
        new = F.when(e["slot"] < 4, 0).when(e["slot"] < 8, 1).when(e["slot"] < copies, e["slot"] - 7).otherwise(0)
        return F.concat(joined(at, e["pos"] - at), F.repeat(F.lit("D"), new.cast("int")), F.translate(joined(e["pos"], gone(e)), "=XD", "II"))

    last = F.element_at(edits, -1)
    at = F.when(F.size(edits) > 0, last["pos"] + gone(last)).otherwise(F.lit(0))
    return F.concat(F.array_join(F.transform(edits, piece), ""), joined(at, F.size(columns)))


def bootstrap_path(reference_len: Column, query_len: Column) -> Column:
    """A path along the diagonal: reference position round(q * reference_len / query_len) after q query bases."""
    at = lambda q: F.floor(q * reference_len / query_len + F.lit(0.5))

    def step(q: Column) -> Column:
        move = (at(q) - at(q - 1)).cast("int")
        return F.when(move == 0, F.lit("I")).otherwise(F.concat(F.lit("="), F.repeat(F.lit("D"), move - 1)))

    steps = F.array_join(F.transform(F.sequence(F.lit(1), query_len.cast("int")), step), "")
    return F.when(query_len == 0, F.repeat(F.lit("D"), reference_len.cast("int"))).otherwise(steps)


def slot_kind(slot: Column, layout: Layout) -> Column:
    """struct(kind, length, base): sub, ins, copy or del, how many bases, and the base of the first two."""
    base = F.substring(F.lit(BASES), F.pmod(slot, F.lit(4)) + 1, F.lit(1))
    none = F.lit(None).cast("string")
    pick = lambda kind, n, b: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("length"), b.alias("base"))
    return (
        F.when(slot < 4, pick("sub", F.lit(1), base)).when(slot < 8, pick("ins", F.lit(1), base))
        .when(slot < 8 + layout.copies, pick("copy", slot - 7, none)).otherwise(pick("del", slot - 7 - layout.copies, none))
    )


def edit_fits(seq_len: Column, pos: Column, slot: Column, layout: Layout) -> Column:
    """Whether the edit is possible at 0-based `pos`: only insertions are at the end."""
    copies = 8 + layout.copies
    return F.when(slot < 4, pos < seq_len).when(slot < 8, pos <= seq_len).when(slot < copies, pos + slot - 7 <= seq_len).otherwise(pos + slot - 7 - layout.copies <= seq_len)


def apply_edit(seq: Column, pos: Column, slot: Column, layout: Layout) -> Column:
    """The sequence after one edit: a copy of n repeats the n bases from `pos` on before `pos`."""
    head = lambda n: F.substring(seq, F.lit(1), n)
    tail = lambda n: F.substring(seq, n + 1, F.length(seq))
    base = F.substring(F.lit(BASES), F.pmod(slot, F.lit(4)) + 1, F.lit(1))
    return (
        F.when(slot < 4, F.concat(head(pos), base, tail(pos + 1))).when(slot < 8, F.concat(head(pos), base, tail(pos)))
        .when(slot < 8 + layout.copies, F.concat(head(pos + slot - 7), tail(pos))).otherwise(F.concat(head(pos), tail(pos + slot - 7 - layout.copies)))
    )


def greedy_edits(rows: Column, cooldown: Column, layout: Layout, seq_len: Column) -> Column:
    """Edits taken left to right from an array of struct(pos, slot) sorted by pos: after one, `cooldown` positions rest.

    An edit takes one position, a deletion as many as it deletes; at the end of the sequence only insertions count.
    """
    copies = 8 + layout.copies
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<pos:int,slot:int>>").alias("taken"))

    def step(s: Column, row: Column) -> Column:
        pos, slot = row["pos"], row["slot"]
        takes = (pos >= s["free"]) & ((pos < seq_len) | slot.between(4, 7))
        width = F.when(slot >= copies, slot - copies + 1).otherwise(F.lit(1))
        return F.struct(F.when(takes, pos + width + cooldown).otherwise(s["free"]).cast("int").alias("free"), F.when(takes, F.concat(s["taken"], F.array(F.struct(pos.cast("int").alias("pos"), slot.cast("int").alias("slot"))))).otherwise(s["taken"]).alias("taken"))

    return F.aggregate(rows, start, step, lambda s: s["taken"])


def apply_edits(seq: Column, edits: Column, layout: Layout) -> Column:
    """The sequence after non-overlapping edits, an array of struct(pos, slot) sorted by pos."""
    copies = 8 + layout.copies
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, e: Column) -> Column:
        pos, slot = e["pos"], e["slot"]
        base = F.substring(F.lit(BASES), F.pmod(slot, F.lit(4)) + 1, F.lit(1))
        piece = F.when(slot < 8, base).when(slot < copies, F.substring(seq, pos + 1, slot - 7)).otherwise(F.lit(""))
        used = F.when(slot < 4, F.lit(1)).when(slot < copies, F.lit(0)).otherwise(slot - copies + 1)
        return F.struct((pos + used).cast("int").alias("at"), F.concat(s["out"], F.substring(seq, s["at"] + 1, pos - s["at"]), piece).alias("out"))

    return F.aggregate(edits, start, step, lambda s: F.concat(s["out"], F.substring(seq, s["at"] + 1, F.length(seq))))


#: A cell of an affine table is one long: its score times this, plus the cell where its path begins.
CELL = 1 << 32


def affine_ends(reference: Column, query: Column, scores: tuple[int, int, int, int], mode: str = "local") -> Column:
    """struct(score, ref_start, ref_end, query_start, query_end) of a best affine alignment, as a max-plus fold in lambdas alone.

    `scores` are for a match, a mismatch, the first and each further base of a gap.  local: any part of both; global: both
    whole; infix: the whole query in any part of the reference; overlap: an end of the reference with a beginning of the query.  The
    state is a row of three arrays by reference position whose cells carry the place where their path begins, so ends come
    without a traceback: (query position) x (reference length + 1) + (reference position).  Of paths that tie, the one that
    begins last is taken, and of those the one that ends first.  A local alignment without a match is empty, at 0.  A
    query and reference of under 2**32 cells together are exact; null gives null.
    """
    if mode not in ("local", "global", "infix", "overlap"):
        raise ValueError(f"no such mode: {mode}")
    local = mode == "local"
    low = F.lit(-(10**6) * CELL)
    match, mismatch, gap, extend = (F.lit(s * CELL) for s in scores)
    long = lambda c: c.cast("long")
    letters = lambda s: _letters(F.upper(s))

    def shifted(row: Column, by: Column, other: Column) -> Column:
        return F.transform(row, lambda _, j: F.when(j < by, other).otherwise(F.get(row, j - by)))

    def floored(v: Column, at: Column) -> Column:
        """A local path may begin anywhere, with nothing."""
        return F.greatest(v, at) if local else v

    def bound(**values: Column) -> Callable[[Callable[[Column], Column]], Column]:
        """`values` as fields of one struct, worked out once."""
        return lambda use: F.transform(F.array(F.struct(*[v.alias(c) for c, v in values.items()])), use)[0]

    def deletions(m: Column, i: Column, steps: Column, at: Column) -> Column:
        opened = F.zip_with(m, i, lambda a, b: F.greatest(a, b) + gap)
        twice = lambda row, k: F.transform(row, lambda v, j: F.when(j < k, v).otherwise(F.greatest(v, F.get(row, (j - k).cast("int")) + k * extend)))
        run = F.aggregate(steps, shifted(opened, F.lit(1), low), twice)
        return F.transform(run, lambda v, j: floored(v, at + j)) if local else run

    def better(s: Column, m: Column, i: Column, d: Column, at: Column) -> Column:
        """struct(best, cell): with what this row ends."""
        if local:
            top, cell = F.array_max(m), lambda t: at + F.array_position(m, t) - 1
            take = lambda t: (t > s["best"]) & (t >= CELL)
        else:
            top, cell = F.greatest(F.element_at(m, -1), F.element_at(i, -1), F.element_at(d, -1)), lambda t: at + F.size(m) - 1
            take = lambda t: t > s["best"]
        return bound(t=top)(lambda b: F.struct(F.when(take(b["t"]), b["t"]).otherwise(s["best"]).alias("best"), long(F.when(take(b["t"]), cell(b["t"])).otherwise(s["cell"])).alias("cell")))

    def row(s: Column, m: Column, i: Column, at: Column) -> Column:
        with_d = bound(m=m, i=i)(lambda r: F.struct(r["m"].alias("m"), r["i"].alias("i"), deletions(r["m"], r["i"], s["steps"], at).alias("d")))
        whole = lambda r, e: F.struct(s["x"].alias("x"), s["steps"].alias("steps"), long(at).alias("at"), r["m"].alias("m"), r["i"].alias("i"), r["d"].alias("d"), e["best"].alias("best"), e["cell"].alias("cell"))
        keeps = lambda r: better(s, r["m"], r["i"], r["d"], at) if mode in ("local", "overlap") else F.struct(s["best"].alias("best"), s["cell"].alias("cell"))
        return bound(r=with_d)(lambda b: whole(b["r"], keeps(b["r"])))

    def step(s: Column, y: Column) -> Column:
        at = s["at"] + F.size(s["m"])
        best = lambda j: F.greatest(F.get(s["m"], j), F.get(s["i"], j), F.get(s["d"], j))
        m = F.transform(s["m"], lambda _, j: floored(F.when(j == 0, low).otherwise(best(j - 1) + F.when(F.get(s["x"], j - 1) == y, match).otherwise(mismatch)), at + j))
        i = F.transform(s["m"], lambda v, j: floored(F.greatest(v + gap, F.get(s["i"], j) + extend), at + j))
        return row(s, m, i, at)

    x = letters(reference)
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(x) + 1)).cast("int") - 1, F.lit(0))), lambda k: long(F.call_function("shiftleft", F.lit(1), k)))
    begin = lambda j: long(F.when(j == 0, F.lit(0)).otherwise(low)) if mode == "global" else long(j)
    empty = F.lit(0).cast("long") if local else low
    first = bound(x=x, steps=steps, m=F.transform(F.sequence(F.lit(0), F.size(x)), begin), best=empty, cell=F.lit(0).cast("long"))
    start = first(lambda s: row(s, s["m"], F.transform(s["m"], lambda _, j: floored(low, long(j))), F.lit(0).cast("long")))

    def ends(s: Column) -> Column:
        width = F.size(s["m"])
        if mode == "infix":
            tops = F.zip_with(F.zip_with(s["m"], s["i"], lambda a, b: F.greatest(a, b)), s["d"], lambda a, b: F.greatest(a, b))
            found = bound(t=F.array_max(tops), a=tops)(lambda b: F.struct(b["t"].alias("best"), long(s["at"] + F.array_position(b["a"], b["t"]) - 1).alias("cell")))
        elif mode == "global":
            found = F.struct(F.greatest(F.element_at(s["m"], -1), F.element_at(s["i"], -1), F.element_at(s["d"], -1)).alias("best"), long(s["at"] + width - 1).alias("cell"))
        else:
            found = F.struct(s["best"].alias("best"), s["cell"].alias("cell"))
        part = lambda v, w: F.floor(v / w).cast("long")
        return bound(f=found, w=width)(lambda b: F.struct(
            F.call_function("shiftright", b["f"]["best"], F.lit(32)).alias("score"),
            (F.pmod(F.pmod(b["f"]["best"], F.lit(CELL)), b["w"])).cast("long").alias("ref_start"), F.pmod(b["f"]["cell"], b["w"]).cast("long").alias("ref_end"),
            part(F.pmod(b["f"]["best"], F.lit(CELL)), b["w"]).alias("query_start"), part(b["f"]["cell"], b["w"]).alias("query_end"),
        ))

    return F.when(reference.isNotNull() & query.isNotNull(), F.aggregate(letters(query), start, step, ends))


def edit_distance_by_rows(a: Column, b: Column) -> Column:
    """Edit distance as a fold of rows of the distance table, in lambdas alone: the native form of the forward table.

    The state is one row whose size doesn't change: what a cell gets from above comes by `transform`, what runs along the row by
    doubling the reach of a minimum.  A null argument gives null.
    """

    def row(s: Column, y: Column) -> Column:
        above, xs = s["row"], s["xs"]
        start = F.transform(above, lambda v, j: F.when(j == 0, v + 1).otherwise(F.least(v + 1, F.get(above, j - 1) + (F.get(xs, j - 1) != y).cast("int"))))
        along = lambda r, k: F.transform(r, lambda v, j: F.when(j < k, v).otherwise(F.least(v, F.get(r, j - k) + k)))
        return F.struct(xs.alias("xs"), s["steps"].alias("steps"), F.aggregate(s["steps"], start, along).alias("row"))

    letters = _letters(a)
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(letters) + 1)).cast("int") - 1, F.lit(0))), lambda k: F.call_function("shiftleft", F.lit(1), k))
    start = F.struct(letters.alias("xs"), steps.alias("steps"), F.sequence(F.lit(0), F.size(letters)).alias("row"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(_letters(b), start, row, lambda s: F.element_at(s["row"], -1).cast("long")))
