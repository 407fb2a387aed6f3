"""The registered queries, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.model import DEFAULT_INSERT, DEFAULT_OTHER, DEFAULT_SAME, DEFAULT_TRANSITIONS, STATES, TRANSITIONS, default_model, forward_log_likelihood, normalised, path_log_likelihood, to_row
from ..operators import align, assembly, edits, fit, polish, simulate, windows
from ..operators.tables import dealt
from .sequences import LENGTH, SQL_DRAFTS, SQL_PAIRS, SQL_READS, SQL_TEMPLATES, drafts, pairs, reads, sql_edits, table, templates

AFFINE = (3, -6, -10, -2)
CHUNK, OVERLAP = 10, 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@_query(f"WITH {SQL_READS} SELECT tid, rid, levenshtein(tpl, rd)::BIGINT AS distance FROM reads")
def edit_distance(spark, sf_dir):
    return reads(spark, sf_dir).select("tid", "rid", F.levenshtein("tpl", "rd").cast("long").alias("distance"))


@_query(f"WITH {SQL_PAIRS} SELECT tid, CASE WHEN levenshtein(ref, query) <= 3 THEN levenshtein(ref, query) ELSE -1 END::BIGINT AS distance FROM pairs")
def edit_distance_threshold(spark, sf_dir):
    return pairs(spark, sf_dir).select("tid", F.levenshtein("ref", "query", 3).cast("long").alias("distance"))


@_query(f"WITH {SQL_PAIRS} SELECT tid, levenshtein(ref, query)::BIGINT AS distance FROM pairs")
def edit_dp_lambda(spark, sf_dir):
    return pairs(spark, sf_dir).select("tid", S.edit_distance_by_rows(F.col("ref"), F.col("query")).alias("distance"))


@_query(f"WITH {SQL_READS} SELECT tid, rid, reverse(translate(rd, 'ACGT', 'TGCA')) AS revcomp FROM reads")
def revcomp(spark, sf_dir):
    return reads(spark, sf_dir).select("tid", "rid", S.reverse_complement(F.col("rd")).alias("revcomp"))


@_query("SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents")
def seq_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.clean(F.col("text")).alias("seq"))


#: A path for every line item: as many matches, mismatches, insertions and deletions as its key's digits say.
_SQL_PATHS = "paths AS (SELECT l_orderkey, l_linenumber, repeat('=', (l_orderkey % 13)::INT) || repeat('X', l_linenumber % 3) || repeat('I', (l_partkey % 5)::INT) || repeat('=', 2) || repeat('D', (l_suppkey % 4)::INT) AS path FROM lineitem)"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("concat(repeat('=', cast(l_orderkey % 13 as int)), repeat('X', l_linenumber % 3), repeat('I', cast(l_partkey % 5 as int)), '==', repeat('D', cast(l_suppkey % 4 as int)))").alias("path"))


@_query(f"""WITH {_SQL_PATHS} SELECT l_orderkey, l_linenumber, translate(path, 'ID', 'DI') AS flipped, length(replace(path, 'I', ''))::BIGINT AS ref_len,
    length(replace(path, 'D', ''))::BIGINT AS query_len, length(replace(path, '=', ''))::BIGINT AS nonmatches FROM paths""")
def path_functions(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("l_orderkey", "l_linenumber", S.flip(p).alias("flipped"), S.reference_length(p).alias("ref_len"), S.query_length(p).alias("query_len"), S.nonmatches(p).alias("nonmatches"))


@_query("""WITH c AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 3 + 1) || 'S' || (l_partkey % 40 + 1) || CASE l_linenumber % 3 WHEN 0 THEN 'M' WHEN 1 THEN '=' ELSE 'X' END
        || (l_suppkey % 7 + 1) || 'I' || (l_linenumber + 1) || 'D' || (l_orderkey % 11 + 1) || 'M' || (l_partkey % 2 + 1) || 'H' AS cigar FROM lineitem)
    SELECT l_orderkey, l_linenumber, array_to_string([repeat(translate(right(x, 1), 'M=XISHD', '===IIID'), left(x, length(x) - 1)::INT) FOR x IN regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')], '') AS path FROM c""")
def cigar_expand(spark, sf_dir):
    cigar = F.expr("""concat(l_orderkey % 3 + 1, 'S', l_partkey % 40 + 1, case l_linenumber % 3 when 0 then 'M' when 1 then '=' else 'X' end,
        l_suppkey % 7 + 1, 'I', l_linenumber + 1, 'D', l_orderkey % 11 + 1, 'M', l_partkey % 2 + 1, 'H')""")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.cigar_path(cigar).alias("path"))


@_query(f"""WITH {SQL_PAIRS}, stepped AS (SELECT *, repeat('=', least(length(ref), length(query))::INT) || repeat('D', greatest(length(ref) - length(query), 0)::INT) || repeat('I', greatest(length(query) - length(ref), 0)::INT) AS path FROM pairs)
    SELECT tid, rpad(ref, greatest(length(ref), length(query))::INT, ' ') AS top,
        array_to_string([CASE WHEN i > least(length(ref), length(query)) THEN ' ' WHEN substr(ref, i, 1) = substr(query, i, 1) THEN '|' ELSE 'X' END FOR i IN range(1, greatest(length(ref), length(query)) + 1)], '') AS middle,
        rpad(query, greatest(length(ref), length(query))::INT, ' ') AS bottom FROM stepped""")
def three_way(spark, sf_dir):
    path = F.expr("concat(repeat('=', least(length(ref), length(query))), repeat('D', greatest(length(ref) - length(query), 0)), repeat('I', greatest(length(query) - length(ref), 0)))")
    rows = pairs(spark, sf_dir).withColumn("a", S.three_way(F.col("ref"), F.col("query"), path))
    return rows.select("tid", F.col("a.ref").alias("top"), F.col("a.mid").alias("middle"), F.col("a.query").alias("bottom"))


@_query(f"""WITH {SQL_PAIRS}, q AS (SELECT tid, length(ref) AS r, length(query) AS n FROM pairs)
    SELECT tid, array_to_string([CASE WHEN floor(i * r / n + 0.5) = floor((i - 1) * r / n + 0.5) THEN 'I' ELSE '=' || repeat('D', (floor(i * r / n + 0.5) - floor((i - 1) * r / n + 0.5) - 1)::INT) END FOR i IN range(1, n + 1)], '') AS path FROM q""")
def bootstrap_paths(spark, sf_dir):
    return pairs(spark, sf_dir).select("tid", S.bootstrap_path(F.length("ref"), F.length("query")).alias("path"))


@_query(f"""WITH {SQL_TEMPLATES}, n AS (SELECT tid, tpl, greatest((length(tpl) - {CHUNK}) // {CHUNK - OVERLAP}, 0) AS last FROM templates)
    SELECT tid::VARCHAR AS template_id, c::INT AS chunk_id, (c * {CHUNK - OVERLAP})::INT AS start, (CASE WHEN c = last THEN length(tpl) ELSE c * {CHUNK - OVERLAP} + {CHUNK} END)::INT AS "end",
        substr(tpl, c * {CHUNK - OVERLAP} + 1, CASE WHEN c = last THEN length(tpl) ELSE {CHUNK} END) AS draft FROM n, range(0, 20) r(c) WHERE c <= last""")
def chunk_grid(spark, sf_dir):
    return assembly.chunk_grid(templates(spark, sf_dir).select(F.col("tid").cast("string").alias("id"), F.col("tpl").alias("seq")), CHUNK, OVERLAP)


@_query(f"""WITH {SQL_READS}, a AS (SELECT rid, tid, rid % 5 AS start, rid % 5 + 12 + rid % 9 AS "end" FROM reads), n AS (SELECT tid, length(tpl) AS len, greatest((length(tpl) - {CHUNK}) // {CHUNK - OVERLAP}, 0) AS last FROM templates)
    SELECT rid, a.tid::VARCHAR AS r_name, c::INT AS chunk_id FROM a JOIN n ON a.tid = n.tid, range(0, 20) r(c)
    WHERE c <= last AND start <= c * {CHUNK - OVERLAP} AND "end" >= CASE WHEN c = last THEN len ELSE c * {CHUNK - OVERLAP} + {CHUNK} END""")
def chunk_assign(spark, sf_dir):
    rows = reads(spark, sf_dir).select("rid", F.col("tid").cast("string").alias("r_name"), (F.col("rid") % 5).alias("start"), (F.col("rid") % 5 + 12 + F.col("rid") % 9).alias("end"))
    lengths = templates(spark, sf_dir).select(F.col("tid").cast("string").alias("r_name"), F.length("tpl").alias("length"))
    return assembly.spanned_chunks(rows, lengths, CHUNK, OVERLAP).select("rid", "r_name", "chunk_id")


#: A read's path to its template, and (with `edits`) three edits by its number.
_PATH = "case l_linenumber % 3 when 0 then concat(repeat('=', p - 1), 'D', repeat('=', 24 - p)) when 1 then concat(repeat('=', p - 1), 'X', repeat('=', 24 - p)) else concat(repeat('=', p), 'I', repeat('=', 24 - p)) end"
_SQL_READ_PATHS = SQL_READS + f""",
    read_paths AS (SELECT *, row_number() OVER () AS own, {_PATH.replace(' case', '').replace('24 - p', '(24 - p)::INT').replace('p - 1', '(p - 1)::INT')} AS path FROM
        (SELECT tid, rid, tpl, rd, (rid % 10) AS l_linenumber, (1 + ((rid // 10) * 7 + (rid % 10) * 13) % 24)::INT AS p FROM reads))"""


def _read_paths(spark, sf_dir):
    rows = reads(spark, sf_dir).withColumns({"l_linenumber": F.col("rid") % 10, "p": F.expr("cast(1 + ((rid div 10) * 7 + (rid % 10) * 13) % 24 as int)")})
    return rows.select("tid", "rid", "tpl", "rd", F.expr(_PATH).alias("path"))


@_query(f"""WITH {_SQL_READ_PATHS}, last AS (SELECT tid, greatest((length(tpl) - {CHUNK}) // {CHUNK - OVERLAP}, 0) AS last, length(tpl) AS n FROM templates),
    chunks AS (SELECT tid, c::INT AS chunk_id, c * {CHUNK - OVERLAP} AS a, CASE WHEN c = last THEN n ELSE c * {CHUNK - OVERLAP} + {CHUNK} END AS b FROM last, range(0, 20) r(c) WHERE c <= last),
    steps AS (SELECT tid, rid, own, rd, i, substr(path, i, 1) AS op, length(replace(substr(path, 1, i - 1), 'I', '')) AS r, length(replace(substr(path, 1, i - 1), 'D', '')) AS q
              FROM (SELECT *, unnest(range(1, length(path) + 1)) AS i FROM read_paths))
    SELECT tid::VARCHAR AS template_id, chunk_id, rid AS read_id, substr(any_value(rd), min(q)::INT + 1, (count(*) FILTER (op <> 'D'))::INT) AS read, string_agg(op, '' ORDER BY i) AS path
    FROM steps JOIN chunks USING (tid) WHERE r < b AND (r >= a AND op <> 'I' OR r > a) GROUP BY tid, chunk_id, rid, own""")
def sub_reads(spark, sf_dir):
    """Each read and its path cut to the chunks of its template."""
    rows = _read_paths(spark, sf_dir).select(F.col("tid").cast("string").alias("r_name"), F.col("rid").alias("read_id"), F.col("rd").alias("seq"), "path", F.lit(0).alias("start"), F.length("tpl").alias("end"))
    lengths = templates(spark, sf_dir).select(F.col("tid").cast("string").alias("r_name"), F.length("tpl").alias("length"))
    return assembly.sub_reads(assembly.spanned_chunks(rows, lengths, CHUNK, OVERLAP).withColumnRenamed("r_name", "template_id"))


@_query(f"""WITH {_SQL_READ_PATHS}, edits AS (SELECT rid, path, regexp_extract_all(path, 'I*[=XD]|I+$') AS cols,
        [[rid % 5, rid % 14], [rid % 5 + 6, (rid // 3) % 14], [24, 4 + rid % 4]] AS edits FROM read_paths)
    SELECT rid, array_to_string([repeat('D', list_sum([CASE WHEN e[1] = j THEN CASE WHEN e[2] < 4 THEN 0 WHEN e[2] < 8 THEN 1 WHEN e[2] < 11 THEN e[2] - 7 ELSE 0 END ELSE 0 END FOR e IN edits])::INT)
        || CASE WHEN list_sum([CASE WHEN e[2] >= 11 AND j >= e[1] AND j < e[1] + e[2] - 10 THEN 1 ELSE 0 END FOR e IN edits]) > 0 THEN translate(coalesce(cols[j + 1], ''), '=XD', 'II') ELSE coalesce(cols[j + 1], '') END
        FOR j IN range(0, 25)], '') AS path FROM edits""")
def lift_over(spark, sf_dir):
    """Each read's path carried over three edits of its template."""
    edit = lambda pos, slot: F.struct(F.expr(pos).cast("int").alias("pos"), F.expr(slot).cast("int").alias("slot"))
    rows = _read_paths(spark, sf_dir).select("rid", S.path_columns(F.col("path")).alias("cols"), F.array(edit("rid % 5", "rid % 14"), edit("rid % 5 + 6", "(rid div 3) % 14"), edit("24", "4 + rid % 4")).alias("edits"))
    return rows.select("rid", S.lifted(F.col("cols"), F.col("edits"), S.T14).alias("path"))


_FATES = """CASE WHEN pos <= 0 THEN 'unmapped' WHEN cigar = '*' THEN 'no_cigar' WHEN cigar LIKE '%N%' THEN 'skips' WHEN last IS NULL THEN 'no_template' WHEN NOT known THEN 'no_read' WHEN len(chunks) = 0 THEN 'no_chunk' ELSE 'used' END"""


@_query(f"""WITH {SQL_READS}, n AS (SELECT tid::VARCHAR AS r_name, length(tpl) AS len, greatest((length(tpl) - {CHUNK}) // {CHUNK - OVERLAP}, 0) AS last FROM templates),
    a AS (SELECT rid, CASE WHEN rid % 11 = 0 THEN 'none' ELSE tid::VARCHAR END AS r_name, rid % 6 AS pos, rid % 13 <> 0 AS known, 8 + rid % 9 AS span,
          CASE rid % 7 WHEN 0 THEN '*' WHEN 1 THEN '4M2N4M' ELSE (8 + rid % 9) || 'M' END AS cigar FROM reads),
    told AS (SELECT *, {_FATES} AS event FROM (SELECT a.*, last, [c FOR c IN range(0, last + 1) IF pos - 1 <= c * {CHUNK - OVERLAP} AND pos - 1 + span >= CASE WHEN c = last THEN len ELSE c * {CHUNK - OVERLAP} + {CHUNK} END] AS chunks FROM a LEFT JOIN n USING (r_name))),
    depth AS (SELECT r_name, c, count(*) AS d FROM (SELECT r_name, unnest(chunks) AS c FROM told WHERE event = 'used') GROUP BY ALL),
    deep AS (SELECT n.r_name, CASE WHEN d >= 5 THEN 'deep_chunk' ELSE 'thin_chunk' END AS event FROM n JOIN range(0, 20) r(c) ON c <= last LEFT JOIN depth ON depth.r_name = n.r_name AND depth.c = r.c)
    SELECT r_name, event, count(*) AS n FROM (SELECT r_name, event FROM told UNION ALL SELECT * FROM deep) GROUP BY ALL""")
def assembly_trace(spark, sf_dir):
    """What becomes of alignments and chunks before an assembly is polished."""
    rows = reads(spark, sf_dir)
    cigar = F.expr("case rid % 7 when 0 then '*' when 1 then '4M2N4M' else concat(8 + rid % 9, 'M') end")
    name = F.expr("case when rid % 11 = 0 then 'none' else cast(tid as string) end")
    alignments = rows.select(F.col("rid").cast("string").alias("q_name"), name.alias("r_name"), F.lit(0).alias("flag"), (F.col("rid") % 6).cast("int").alias("pos"), cigar.alias("cigar"))
    sequences = rows.filter("rid % 13 <> 0").select(F.col("rid").cast("string").alias("id"), F.col("rd").alias("seq"))
    return assembly.assembly_trace(templates(spark, sf_dir).select(F.col("tid").cast("string").alias("id"), F.col("tpl").alias("seq")), sequences, alignments, CHUNK, OVERLAP)


@_query(f"WITH {SQL_READS} SELECT t.tid, count(r.rid) AS n_reads, coalesce(sum(length(r.rd)), 0)::BIGINT AS bases FROM templates t LEFT JOIN reads r ON t.tid = r.tid GROUP BY t.tid")
def reads_join(spark, sf_dir):
    t, r = templates(spark, sf_dir).select("tid"), reads(spark, sf_dir).select("tid", "rid", "rd")
    return t.join(r, "tid", "left").groupBy("tid").agg(F.count("rid").alias("n_reads"), F.coalesce(F.sum(F.length("rd")), F.lit(0)).cast("long").alias("bases"))


@_query(f"WITH {SQL_READS} SELECT tid, rid FROM reads QUALIFY count(*) OVER (PARTITION BY tid) >= 30")
def coverage_filter(spark, sf_dir):
    r = reads(spark, sf_dir).select("tid", "rid")
    return r.join(r.groupBy("tid").count().filter("count >= 30"), "tid", "left_semi")


@_query(f"WITH {SQL_READS} SELECT tid, rid FROM reads QUALIFY row_number() OVER (PARTITION BY tid ORDER BY rid) <= 10")
def take_num(spark, sf_dir):
    return polish.take_reads(reads(spark, sf_dir).select("tid", "rid"), "tid", "rid", 10)


@_query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber < 4 THEN 'sub' WHEN s < 8 THEN 'ins' WHEN s < 11 THEN 'copy' ELSE 'del' END) AS kind,
        (CASE WHEN s < 8 THEN 1 WHEN s < 11 THEN s - 7 ELSE s - 10 END)::INT AS n, CASE WHEN s < 8 THEN substr('ACGT', s % 4 + 1, 1) END AS base
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 4 THEN l_linenumber % 4 ELSE 4 + (l_orderkey % 10)::INT END AS s FROM lineitem)""")
def slot_edits(spark, sf_dir):
    slot = F.expr("case when l_linenumber < 4 then l_linenumber % 4 else 4 + cast(l_orderkey % 10 as int) end")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.slot_kind(slot, S.T14).alias("e"))
    return rows.select("l_orderkey", "l_linenumber", "e.kind", F.col("e.length").alias("n"), "e.base")


_SQL_T9 = f"{SQL_READS}, {SQL_DRAFTS}, {sql_edits('drafts', 'draft', 0, 1)}, cells AS (SELECT e.tid, pos, slot, sum(levenshtein(edited, rd))::BIGINT AS score FROM edits e JOIN reads r ON e.tid = r.tid GROUP BY ALL), totals AS (SELECT d.tid, sum(levenshtein(draft, rd))::BIGINT AS total FROM drafts d JOIN reads r ON d.tid = r.tid GROUP BY ALL)"
_SQL_T16 = f"{SQL_READS}, {SQL_DRAFTS}, {sql_edits('drafts', 'draft', 4, 4)}, cells AS (SELECT e.tid, pos, slot, sum(levenshtein(edited, rd))::BIGINT AS score FROM edits e JOIN reads r ON e.tid = r.tid GROUP BY ALL), totals AS (SELECT d.tid, sum(levenshtein(draft, rd))::BIGINT AS total FROM drafts d JOIN reads r ON d.tid = r.tid GROUP BY ALL)"


def _draft_reads(spark, sf_dir):
    d = drafts(spark, sf_dir).select("tid", "draft")
    return d, reads(spark, sf_dir).select("tid", "rd")


def _tables(spark, sf_dir, layout, model=None):
    """Drafts, their reads' tables, and whether a draft's reads are in more than one part."""
    d, r = _draft_reads(spark, sf_dir)
    return d, *edits.part_tables(r.join(d, "tid"), ["tid"], "draft", "rd", layout, model=model)


def _cells(spark, sf_dir, layout):
    _, tables, deep = _tables(spark, sf_dir, layout)
    return edits.summed_tables(tables, "tid", layout, deep).withColumn("score", F.col("score").cast("long"))


@_query(f"WITH {_SQL_T9} SELECT * FROM cells")
def perturb_t9(spark, sf_dir):
    return _cells(spark, sf_dir, S.T9)


@_query(f"WITH {_SQL_T16} SELECT * FROM cells")
def perturb_t16(spark, sf_dir):
    return _cells(spark, sf_dir, S.T16)


@_query(f"WITH {_SQL_T9} SELECT tid, pos, slot, score FROM cells QUALIFY row_number() OVER (PARTITION BY tid, pos ORDER BY score, slot) = 1")
def perturb_argmin(spark, sf_dir):
    _, tables, deep = _tables(spark, sf_dir, S.T9)
    return edits.best_edits(tables, "tid", S.T9, deep=deep, improving=False).withColumn("score", F.col("score").cast("long"))


@_query(f"""WITH {_SQL_T9}, found AS (SELECT c.tid, pos, slot, score FROM cells c JOIN totals t ON c.tid = t.tid WHERE score < total QUALIFY row_number() OVER (PARTITION BY c.tid ORDER BY pos, score, slot) = 1)
    SELECT d.tid, d.draft, f.pos, f.slot, f.score, CASE WHEN f.pos IS NULL THEN draft ELSE edited END AS edited
    FROM drafts d LEFT JOIN found f ON d.tid = f.tid LEFT JOIN edits e ON e.tid = f.tid AND e.pos = f.pos AND e.slot = f.slot""")
def polish_step(spark, sf_dir):
    d, tables, deep = _tables(spark, sf_dir, S.T9)
    better = edits.best_edits(tables, "tid", S.T9, deep=deep).withColumn("score", F.col("score").cast("long"))
    return edits.first_improvement(better, None, d, "tid", "draft", S.T9)


_SQL_GREEDY = f"""WITH RECURSIVE {_SQL_T16}, best AS (SELECT c.tid, pos, slot FROM cells c JOIN totals t ON c.tid = t.tid WHERE score < total QUALIFY row_number() OVER (PARTITION BY c.tid, pos ORDER BY score, slot) = 1),
    usable AS (SELECT b.* FROM best b JOIN drafts d ON b.tid = d.tid WHERE pos < length(draft) OR slot BETWEEN 4 AND 7),
    taken(tid, pos, slot) AS (
        SELECT tid, min(pos), arg_min(slot, pos) FROM usable GROUP BY tid
        UNION ALL
        SELECT t.tid, min(u.pos), arg_min(u.slot, u.pos) FROM taken t JOIN usable u ON u.tid = t.tid AND u.pos >= t.pos + CASE WHEN t.slot >= 12 THEN t.slot - 11 ELSE 1 END + 5 GROUP BY t.tid, t.pos)"""


@_query(f"{_SQL_GREEDY} SELECT tid, pos, slot FROM taken")
def greedy_edits(spark, sf_dir):
    d, tables, deep = _tables(spark, sf_dir, S.T16)
    chosen = edits.choose_edits(d, edits.best_edits(tables, "tid", S.T16, deep=deep), None, "tid", "draft", S.T16, F.lit(5))
    return chosen.select("tid", F.explode("edits").alias("e")).select("tid", "e.pos", "e.slot")


@_query(f"""{_SQL_GREEDY} SELECT tid, 0 AS round, 'voted' AS event, count(*) AS n FROM drafts JOIN reads USING (tid) GROUP BY tid
    UNION ALL SELECT tid, 0, 'edited', count(*) FROM taken GROUP BY tid""")
def polish_trace(spark, sf_dir):
    """What became of reads and edits in the first round over every draft; the band holds the whole table."""
    return polish.polish_traced(*_draft_reads(spark, sf_dir), "tid", "draft", "rd", radius=13, max_rounds=1)[1]


_SQL_WINDOWS = """WITH marked AS (SELECT l_partkey, pos, coalesce(pos - lag(pos) OVER o > 50, true)::INT AS new FROM (SELECT DISTINCT l_partkey, l_orderkey AS pos FROM lineitem) WINDOW o AS (PARTITION BY l_partkey ORDER BY pos)),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY l_partkey ORDER BY pos) AS island FROM marked),
    merged AS (SELECT l_partkey, min(pos) - 25 AS start, max(pos) + 25 AS "end" FROM islands GROUP BY l_partkey, island)"""


@_query(f"{_SQL_WINDOWS} SELECT * FROM merged")
def window_merge(spark, sf_dir):
    return edits.merge_windows(table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("pos")), "l_partkey", 25)


@_query(f"""{_SQL_WINDOWS}, counted AS (SELECT *, CASE WHEN "end" - start < 100 THEN 1 ELSE (("end" - start + 49) // 50 - 1)::BIGINT END AS n FROM merged),
    pieces AS (SELECT *, unnest(range(n)) AS k FROM counted)
    SELECT l_partkey, start + 50 * k AS start, CASE WHEN k = n - 1 THEN "end" ELSE start + 50 * (k + 1) END AS "end" FROM pieces""")
def window_split(spark, sf_dir):
    return windows.split_windows(window_merge(spark, sf_dir), 25)


@_query(f"WITH {SQL_PAIRS} SELECT tid, levenshtein(ref, query)::BIGINT AS distance, levenshtein(ref, query)::BIGINT AS replayed, true AS spans FROM pairs")
def edit_align_path(spark, sf_dir):
    rows = align.edit_paths(pairs(spark, sf_dir), "ref", "query", radius=8, ties="ID=")
    spans = (S.reference_length(F.col("ops")) == F.length("ref")) & (S.query_length(F.col("ops")) == F.length("query"))
    return rows.select("tid", "distance", S.nonmatches(F.col("ops")).alias("replayed"), spans.alias("spans"))


def _sql_affine(mode: str, query: str) -> str:
    """Affine scores (tid, score) by recursion over query positions; a row is three lists by reference position."""
    match, mismatch, gap, extend = AFFINE
    low, local = -1000000, mode == "local"
    floor = 0 if local else low
    cut = lambda x: f"greatest({x}, {floor})"
    columns = "range(1, length(ref) + 2)"
    run = lambda m, i: f"[{cut(f'coalesce(list_max([greatest({m}[k], {i}[k]) + {gap} + (j - k - 1) * {extend} FOR k IN range(1, j)]), {low})')} FOR j IN {columns}]"
    start = f"[CASE WHEN j = 1 THEN 0 ELSE {low if mode == 'global' else 0} END FOR j IN {columns}]"
    best = {"global": f"{low}", "infix": f"{low}", "local": "greatest(list_max(m), list_max(i), list_max(d))", "overlap": "greatest(m[-1], i[-1], d[-1])"}[mode]
    last = {"global": "greatest(m[-1], i[-1], d[-1])", "infix": "greatest(list_max(m), list_max(i), list_max(d))"}.get(mode, "best")
    first_run = run("m", "i") if mode == "global" else f"[{floor} FOR j IN {columns}]"
    return f"""first_{mode} AS (SELECT tid, ref, {query} AS query, {start} AS m, [{low} FOR j IN {columns}] AS i FROM pairs),
        f_{mode}(tid, ref, query, step, m, i, d, best) AS (
            SELECT tid, ref, query, 0::BIGINT, m, i, d, {best} FROM (SELECT *, {first_run} AS d FROM first_{mode})
            UNION ALL
            SELECT tid, ref, query, step, m, i, d, greatest(best, {best}) FROM (SELECT *, {run('m', 'i')} AS d FROM (
                SELECT tid, ref, query, step + 1 AS step, best,
                       [{floor}] || [{cut(f"greatest(m[j], i[j], d[j]) + CASE WHEN substr(ref, j, 1) = substr(query, step + 1, 1) THEN {match} ELSE {mismatch} END")} FOR j IN range(1, length(ref) + 1)] AS m,
                       [{cut(f'greatest(m[j] + {gap}, i[j] + {extend})')} FOR j IN {columns}] AS i
                FROM f_{mode} WHERE step < length(query)))),
        {mode} AS (SELECT tid, {last}::BIGINT AS score FROM f_{mode} WHERE step = length(query))"""


@_query(f"WITH RECURSIVE {SQL_PAIRS}, {_sql_affine('global', 'query')} SELECT tid, score, score AS replayed FROM global")
def affine_global_score(spark, sf_dir):
    """The score, and what its path scores when replayed."""
    rows = align.affine_paths(pairs(spark, sf_dir), "ref", "query", AFFINE).withColumn("a", S.three_way(F.col("ref"), F.col("query"), F.col("ops")))
    match, mismatch, gap, extend = (F.lit(x) for x in AFFINE)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    gaps = count(F.col("ops"), "I+") + count(F.col("ops"), "D+")
    replayed = match * count(F.col("a.mid"), r"\|") + mismatch * count(F.col("a.mid"), "X") + gap * gaps + extend * (count(F.col("ops"), "[ID]") - gaps)
    return rows.select("tid", "score", replayed.cast("long").alias("replayed"))


@_query(f"WITH RECURSIVE {SQL_PAIRS}, {_sql_affine('local', 'query')} SELECT tid, score FROM local")
def affine_local_score(spark, sf_dir):
    return align.affine_paths(pairs(spark, sf_dir), "ref", "query", AFFINE, "local").select("tid", "score")


def _sql_local_ends() -> str:
    """Local scores with the cell where a path begins: a cell is one number, its score times 2**32 plus that cell."""
    match, mismatch, gap, extend = (x * S.CELL for x in AFFINE)
    columns, low = "range(1, length(ref) + 2)", -(10**6) * S.CELL
    run = lambda m, i, at: f"[greatest({at} + j - 1, coalesce(list_max([greatest({m}[k], {i}[k]) + {gap} + (j - k - 1) * {extend} FOR k IN range(1, j)]), {low})) FOR j IN {columns}]"
    start = f"[(j - 1)::BIGINT FOR j IN {columns}]"
    return f"""WITH RECURSIVE {SQL_PAIRS}, first AS (SELECT tid, ref, query, {start} AS m, {start} AS i FROM pairs),
        f(tid, ref, query, step, m, i, d, best, cell) AS (
            SELECT tid, ref, query, 0::BIGINT, m, i, {run('m', 'i', '0')}, 0::BIGINT, 0::BIGINT FROM first
            UNION ALL
            SELECT tid, ref, query, step, m, i, {run('m', 'i', 'start')}, CASE WHEN list_max(m) > best AND list_max(m) >= {S.CELL} THEN list_max(m) ELSE best END,
                   CASE WHEN list_max(m) > best AND list_max(m) >= {S.CELL} THEN start + list_position(m, list_max(m)) - 1 ELSE cell END FROM (
                SELECT tid, ref, query, step + 1 AS step, best, cell, (step + 1) * (length(ref) + 1) AS start,
                       [(step + 1) * (length(ref) + 1)] || [greatest((step + 1) * (length(ref) + 1) + j, greatest(m[j], i[j], d[j]) + CASE WHEN substr(ref, j, 1) = substr(query, step + 1, 1) THEN {match} ELSE {mismatch} END) FOR j IN range(1, length(ref) + 1)] AS m,
                       [greatest((step + 1) * (length(ref) + 1) + j - 1, m[j] + {gap}, i[j] + {extend}) FOR j IN {columns}] AS i
                FROM f WHERE step < length(query)))
        SELECT tid, best // {S.CELL} AS score, best % {S.CELL} % (length(ref) + 1) AS ref_start, cell % (length(ref) + 1) AS ref_end, best % {S.CELL} // (length(ref) + 1) AS query_start, cell // (length(ref) + 1) AS query_end
        FROM f WHERE step = length(query)"""


@_query(_sql_local_ends())
def affine_local_ends(spark, sf_dir):
    """Scores and ends of local alignments by the native fold."""
    return pairs(spark, sf_dir).select("tid", S.affine_ends(F.col("ref"), F.col("query"), AFFINE).alias("a")).select("tid", "a.*")


_INNER, _TAIL = "substring(query, 5, 12)", "concat(substring(query, 10), 'ACGTT')"


@_query(f"WITH RECURSIVE {SQL_PAIRS}, {_sql_affine('infix', _INNER)}, {_sql_affine('overlap', _TAIL)} SELECT i.tid, i.score AS infix_score, o.score AS overlap_score FROM infix i JOIN overlap o ON i.tid = o.tid")
def affine_infix_overlap(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("tid", "ref", F.expr(_INNER).alias("inner"), F.expr(_TAIL).alias("tail"))
    found = align.affine_paths(rows, "ref", "inner", AFFINE, "infix").select("tid", "ref", "tail", F.col("score").alias("infix_score"))
    return align.affine_paths(found, "ref", "tail", AFFINE, "overlap").select("tid", "infix_score", F.col("score").alias("overlap_score"))


#: The path of hmm_path_eval: matches along the shorter sequence, then gaps.
_SQL_LOG = {"mm": DEFAULT_TRANSITIONS[0], "mi": DEFAULT_TRANSITIONS[1], "md": DEFAULT_TRANSITIONS[2], "ii": DEFAULT_TRANSITIONS[4], "dd": DEFAULT_TRANSITIONS[8]}


@_query(f"""WITH {SQL_PAIRS}, n AS (SELECT *, least(length(ref), length(query)) AS k, greatest(length(ref) - length(query), 0) AS d, greatest(length(query) - length(ref), 0) AS i FROM pairs)
    SELECT tid, round(k * ln({_SQL_LOG['mm']}::DOUBLE) + list_sum([CASE WHEN substr(ref, p, 1) = substr(query, p, 1) THEN ln({DEFAULT_SAME}::DOUBLE) ELSE ln({DEFAULT_OTHER}::DOUBLE) END FOR p IN range(1, k + 1)])
        + CASE WHEN d > 0 THEN ln({_SQL_LOG['md']}::DOUBLE) + (d - 1) * ln({_SQL_LOG['dd']}::DOUBLE) ELSE 0 END
        + CASE WHEN i > 0 THEN ln({_SQL_LOG['mi']}::DOUBLE) + (i - 1) * ln({_SQL_LOG['ii']}::DOUBLE) + i * ln({DEFAULT_INSERT}::DOUBLE) ELSE 0 END, 6) AS log_likelihood FROM n""")
def hmm_path_eval(spark, sf_dir):
    path = F.expr("concat(repeat('=', least(length(ref), length(query))), repeat('D', greatest(length(ref) - length(query), 0)), repeat('I', greatest(length(query) - length(ref), 0)))")
    return pairs(spark, sf_dir).select("tid", F.round(path_log_likelihood(F.col("ref"), F.col("query"), path, default_model()), 6).alias("log_likelihood"))


def _sql_forward() -> str:
    """The forward sums by recursion over query positions; a row is three lists by reference position."""
    t = dict(zip(TRANSITIONS, DEFAULT_TRANSITIONS, strict=True))
    into = lambda s, j: " + ".join(f"{t[f'{f}_{s}']}::DOUBLE * {f[0]}[{j}]" for f in STATES)
    decay = t["del_del"]
    # A deletion run into column j sums its starts with powers of the stay probability.
    run = lambda m, i: f"[coalesce(list_sum([({t['mat_del']}::DOUBLE * {m}[k] + {t['ins_del']}::DOUBLE * {i}[k]) * pow({decay}::DOUBLE, j - k - 1) FOR k IN range(1, j)]), 0) FOR j IN range(1, length(ref) + 2)]"
    zero = "[0::DOUBLE FOR j IN range(1, length(ref) + 2)]"
    return f"""WITH RECURSIVE {SQL_PAIRS},
        first AS (SELECT tid, ref, query, [1::DOUBLE] || [0::DOUBLE FOR j IN range(1, length(ref) + 1)] AS m, {zero} AS i FROM pairs),
        f(tid, ref, query, step, m, i, d) AS (
            SELECT tid, ref, query, 0::BIGINT, m, i, {run('m', 'i')} FROM first
            UNION ALL
            SELECT tid, ref, query, step, m, i, {run('m', 'i')} FROM (
                SELECT tid, ref, query, step + 1 AS step,
                       [0::DOUBLE] || [({into('mat', 'j')}) * CASE WHEN substr(ref, j, 1) = substr(query, step + 1, 1) THEN {DEFAULT_SAME}::DOUBLE ELSE {DEFAULT_OTHER}::DOUBLE END FOR j IN range(1, length(ref) + 1)] AS m,
                       [({into('ins', 'j')}) * {DEFAULT_INSERT}::DOUBLE FOR j IN range(1, length(ref) + 2)] AS i
                FROM f WHERE step < length(query)))
        SELECT tid, round(ln(m[-1] + i[-1] + d[-1]), 6) AS log_likelihood FROM f WHERE step = length(query)"""


@_query(_sql_forward())
def hmm_likelihood(spark, sf_dir):
    return align.likelihoods(pairs(spark, sf_dir), "ref", "query").select("tid", F.round("log_likelihood", 6).alias("log_likelihood"))


@_query(_sql_forward())
def hmm_likelihood_native(spark, sf_dir):
    """The same sums by the native fold."""
    rows = pairs(spark, sf_dir)
    return rows.select("tid", F.round(forward_log_likelihood(F.col("ref"), F.col("query"), default_model()), 6).alias("log_likelihood"))


@_query(f"SELECT tid, log_likelihood AS forward, log_likelihood AS backward, true AS agrees FROM ({_sql_forward()})")
def hmm_agreement(spark, sf_dir):
    """Likelihoods by the forward and by the backward table, and whether they agree."""
    return align.both_likelihoods(pairs(spark, sf_dir), "ref", "query").select("tid", F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward"), "agrees")


def _sql_viterbi() -> str:
    """The best paths' log-likelihoods by recursion over query positions; a row is three lists by reference position."""
    low = -1000000
    t = {k: math.log(v) if v > 0 else low for k, v in zip(TRANSITIONS, DEFAULT_TRANSITIONS, strict=True)}
    same, other, insert = (math.log(x) for x in (DEFAULT_SAME, DEFAULT_OTHER, DEFAULT_INSERT))
    columns = "range(1, length(ref) + 2)"
    into = lambda s: "greatest(" + ", ".join(f"{f[0]}[j] + ({t[f'{f}_{s}']}::DOUBLE)" for f in STATES) + ")"
    # A deletion run into column j starts anywhere before it and stays.
    run = f"[coalesce(list_max([greatest(m[k] + ({t['mat_del']}::DOUBLE), i[k] + ({t['ins_del']}::DOUBLE)) + (j - k - 1) * ({t['del_del']}::DOUBLE) FOR k IN range(1, j)]), {low}) FOR j IN {columns}]"
    return f"""WITH RECURSIVE {SQL_PAIRS},
        first AS (SELECT tid, ref, query, [CASE WHEN j = 1 THEN 0 ELSE {low} END::DOUBLE FOR j IN {columns}] AS m, [{low}::DOUBLE FOR j IN {columns}] AS i FROM pairs),
        f(tid, ref, query, step, m, i, d) AS (
            SELECT tid, ref, query, 0::BIGINT, m, i, {run} FROM first
            UNION ALL
            SELECT tid, ref, query, step, m, i, {run} FROM (
                SELECT tid, ref, query, step + 1 AS step,
                       [{low}::DOUBLE] || [{into('mat')} + CASE WHEN substr(ref, j, 1) = substr(query, step + 1, 1) THEN {same}::DOUBLE ELSE {other}::DOUBLE END FOR j IN range(1, length(ref) + 1)] AS m,
                       [{into('ins')} + ({insert}::DOUBLE) FOR j IN {columns}] AS i
                FROM f WHERE step < length(query))),
        found AS (SELECT tid, round(greatest(m[-1], i[-1], d[-1]), 6) AS log_likelihood FROM f WHERE step = length(query))
        SELECT tid, log_likelihood, log_likelihood AS replayed, true AS spans FROM found"""


@_query(_sql_viterbi())
def hmm_viterbi(spark, sf_dir):
    """The best path's log-likelihood, what the path comes to when evaluated step by step, and whether it spans both sequences."""
    rows = align.best_paths(pairs(spark, sf_dir), "ref", "query", radius=10)
    spans = (S.reference_length(F.col("ops")) == F.length("ref")) & (S.query_length(F.col("ops")) == F.length("query"))
    replayed = path_log_likelihood(F.col("ref"), F.col("query"), F.col("ops"), default_model())
    return rows.select("tid", F.round("log_likelihood", 6).alias("log_likelihood"), F.round(replayed, 6).alias("replayed"), spans.alias("spans"))


def _sql_hmm_table() -> str:
    """Each edit's likelihood from what comes before it and what comes after, by recursion over a draft's columns.

    A row of `pre` is one column of a read's table: what enters the column by a match (gm) or a deletion (gd), by query position, and
    with the insertions there what goes on to a match (am) or a deletion (ad).  A row of `post` is what is left from a match (bm) or
    a deletion (bd); `ee` has bm behind a new base, for each of the four.  Every path enters a column once.
    """
    t = {k: f"{v}::DOUBLE" for k, v in zip(TRANSITIONS, DEFAULT_TRANSITIONS, strict=True)}
    columns, insert = "range(1, length(rd) + 2)", f"{DEFAULT_INSERT}::DOUBLE"
    stay = f"({t['ins_ins']} * {insert})"
    emit = lambda base, at: f"CASE WHEN {base} = substr(rd, {at}, 1) THEN {DEFAULT_SAME}::DOUBLE ELSE {DEFAULT_OTHER}::DOUBLE END"
    falling = "[" + ", ".join(f"{(DEFAULT_TRANSITIONS[4] * DEFAULT_INSERT) ** k!r}::DOUBLE" for k in range(2 * LENGTH, -1, -1)) + "]"
    rising = f"list_reverse({falling})"
    run = f"[CASE WHEN j = 1 THEN 0 ELSE list_dot_product(h[1:j - 1], {falling}[{2 * LENGTH + 3} - j:]) END FOR j IN {columns}]"
    entered = f"[({t['mat_ins']} * gm[k] + {t['del_ins']} * gd[k]) * {insert} FOR k IN {columns}]"
    leave = lambda s: f"[{t[f'mat_{s}']} * gm[j] + {t[f'ins_{s}']} * gi[j] + {t[f'del_{s}']} * gd[j] FOR j IN {columns}]"
    left = lambda s: f"[{t[f'{s}_mat']} * x[j] + {t[f'{s}_del']} * z[j] + {t[f'{s}_ins']} * {insert} * coalesce(bi[j + 1], 0) FOR j IN {columns}]"
    ends = lambda s: f"[CASE WHEN j = length(rd) + 1 THEN 1 ELSE {t[f'{s}_ins']} * {insert} * pow({stay}, length(rd) - j) END FOR j IN {columns}]"
    return f"""WITH RECURSIVE {SQL_READS}, {SQL_DRAFTS}, own AS (SELECT tid, draft, rd, row_number() OVER () AS own FROM drafts JOIN reads USING (tid)),
        pre(own, draft, rd, c, gm, gd, am, ad) AS (
            SELECT own, draft, rd, 0, gm, gd, {leave('mat')}, {leave('del')} FROM (SELECT *, {run} AS gi FROM (SELECT *, {entered} AS h FROM (SELECT *, [(j = 1)::INT::DOUBLE FOR j IN {columns}] AS gm, [0::DOUBLE FOR j IN {columns}] AS gd FROM own)))
            UNION ALL
            SELECT own, draft, rd, c, gm, gd, {leave('mat')}, {leave('del')} FROM (SELECT *, {run} AS gi FROM (SELECT *, {entered} AS h FROM (
                SELECT own, draft, rd, c + 1 AS c, [0::DOUBLE] || [am[j] * {emit('substr(draft, c + 1, 1)', 'j')} FOR j IN range(1, length(rd) + 1)] AS gm, ad AS gd FROM pre WHERE c < length(draft))))),
        post(own, draft, rd, c, bm, bd) AS (
            SELECT own, draft, rd, length(draft)::INT, {ends('mat')}, {ends('del')} FROM own
            UNION ALL
            SELECT own, draft, rd, c, {left('mat')}, {left('del')} FROM (
                SELECT *, [list_dot_product(h[j:], {rising}[1:length(rd) + 2 - j]) FOR j IN {columns}] AS bi FROM (SELECT *, [{t['ins_mat']} * x[k] + {t['ins_del']} * z[k] FOR k IN {columns}] AS h FROM (
                    SELECT own, draft, rd, c - 1 AS c, [bm[j + 1] * {emit('substr(draft, c, 1)', 'j')} FOR j IN range(1, length(rd) + 1)] || [0::DOUBLE] AS x, bd AS z FROM post WHERE c > 0)))),
        after AS (SELECT own, c, bm, bd, {', '.join(f"[bm[j + 1] * {emit(repr(b), 'j')} FOR j IN range(1, length(rd) + 1)] || [0::DOUBLE] AS e{k}" for k, b in enumerate('ACGT'))} FROM post),
        joined AS MATERIALIZED (SELECT o.tid, p.c - greatest(-step, 0) AS pos, step, CASE WHEN step <> 0 THEN list_dot_product(p.gm, a.bm) + list_dot_product(p.gd, a.bd) END AS moved,
            {', '.join(f"CASE WHEN step IN (0, 1) THEN list_dot_product(p.am, a.e{k}) + list_dot_product(p.ad, a.bd) END AS b{k}" for k in range(4))}
            FROM pre p CROSS JOIN range(-3, 4) r(step) JOIN after a ON a.own = p.own AND a.c = p.c + step JOIN own o ON o.own = p.own),
        each AS (SELECT tid, pos, CASE WHEN step < 0 THEN 7 - step ELSE 10 + step END AS slot, ln(moved) AS lk FROM joined WHERE step <> 0
            {' '.join(f"UNION ALL SELECT tid, pos, CASE step WHEN 1 THEN {k} ELSE {4 + k} END, ln(b{k}) FROM joined WHERE step IN (0, 1)" for k in range(4))})
        SELECT tid, pos, slot::INT AS slot, round(sum(lk), 4) AS score FROM each GROUP BY ALL"""


@_query(_sql_hmm_table())
def hmm_perturb(spark, sf_dir):
    _, tables, deep = _tables(spark, sf_dir, S.T14, default_model())
    return edits.summed_tables(tables, "tid", S.T14, deep).withColumn("score", F.round("score", 4))


@_query("""SELECT l_partkey, round(m + ln(sum(exp(x - m))), 6) AS total FROM (SELECT l_partkey, -l_quantity AS x, max(-l_quantity) OVER (PARTITION BY l_partkey) AS m FROM lineitem) GROUP BY l_partkey, m""")
def logsumexp(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (-F.col("l_quantity")).alias("x"))
    return rows.groupBy("l_partkey").agg(F.round(S.log_sum_exp(F.sort_array(F.collect_list("x"))), 6).alias("total"))


_WEIGHTS = ("l_quantity", "l_discount + 0.01", "l_tax + 0.01")


@_query(f"""SELECT l_suppkey, {', '.join(f"round(sum({w}) / sum({' + '.join(f'({v})' for v in _WEIGHTS)}), 9) AS mat_{s}" for w, s in zip(_WEIGHTS, STATES, strict=True))},
    {', '.join(f"round({0.25}, 9)::DOUBLE AS emit_{k}" for k in range(2))} FROM lineitem GROUP BY l_suppkey""")
def model_normalize(spark, sf_dir):
    """Sums of one model's rows for every supplier, normalised."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[F.sum(F.expr(w)).alias(f"mat_{s}") for w, s in zip(_WEIGHTS, STATES, strict=True)])
    row = to_row(default_model())
    rest = {t: F.lit(row[t]) for t in TRANSITIONS if not t.startswith("mat_")}
    flat = {"mat_emit": F.array(*[F.col("mat_mat")] * 16), "ins_emit": F.array(*[F.lit(2.0)] * 20)}
    out = normalised(sums.withColumns({**rest, **flat}))
    return out.select("l_suppkey", *[F.round(f"mat_{s}", 9).alias(f"mat_{s}") for s in STATES], F.round(F.col("mat_emit")[0], 9).alias("emit_0"), F.round(F.col("ins_emit")[19], 9).alias("emit_1"))


@_query()
def polish_edit(spark, sf_dir):
    d, r = _draft_reads(spark, sf_dir)
    return polish.polish(d, r, "tid", "draft", "rd", radius=8)


@_query()
def polish_hmm(spark, sf_dir):
    d, r = _draft_reads(spark, sf_dir)
    return polish.polish(d, r, "tid", "draft", "rd", radius=8, model=default_model())


@_query()
def polish_focused(spark, sf_dir):
    return windows.polish_focused(*_draft_reads(spark, sf_dir), "tid", "draft", "rd", radius=8, rest=5, width=6)


@_query()
def fit_model(spark, sf_dir):
    rows = reads(spark, sf_dir).withColumn("forward", F.col("rid") % 2 == 0)
    start = {True: default_model(), False: default_model()}
    models = fit.fit(rows, "tpl", "rd", start, 1, strand="forward", radius=8)
    return spark.createDataFrame([(s, *[round(float(x), 6) for x in m.t.ravel()]) for s, m in sorted(models.items())], "is_forward boolean, " + ", ".join(f"{t} double" for t in TRANSITIONS))


@_query()
def assembly_polish(spark, sf_dir):
    """Ten templates of parts make a contig; its reads are those of the parts, aligned at their place."""
    parts = drafts(spark, sf_dir).withColumns({"id": F.expr("concat('c', tid div 10)"), "k": F.col("tid") % 10})
    at = F.coalesce(F.sum(F.length("draft")).over(Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("at", at)
    contigs = placed.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "draft"))), lambda s: s["draft"]), "").alias("seq"))
    rows = reads(spark, sf_dir).join(placed.select("tid", "id", "at", F.length("draft").alias("n")), "tid")
    aligned = rows.select(F.col("rid").cast("string").alias("q_name"), F.col("id").alias("r_name"), F.when(F.col("rid") % 2 == 0, 16).otherwise(0).alias("flag"), (F.col("at") + 1).cast("int").alias("pos"), "rd", "n")
    m, rest = F.least(F.length("rd"), F.col("n")), F.length("rd") - F.col("n")
    cigar = F.concat(m, F.lit("M"), F.when(rest > 0, F.concat(rest, F.lit("I"))).when(rest < 0, F.concat(-rest, F.lit("D"))).otherwise(""))
    alignments = aligned.select("q_name", "r_name", "flag", "pos", cigar.alias("cigar"))
    sequences = aligned.select(F.col("q_name").alias("id"), F.when(F.col("flag") == 16, S.reverse_complement(F.col("rd"))).otherwise(F.col("rd")).alias("seq"))
    return assembly.polish_assembly(contigs, sequences, alignments, chunk_size=22, overlap=4, radius=8)


@_query()
def simulate_reads(spark, sf_dir):
    return simulate.simulate_reads(templates(spark, sf_dir), "tid", "tpl", 5, simulate.Profile())


@_query()
def sample_reads_hmm(spark, sf_dir):
    return dealt(templates(spark, sf_dir), "tid").select("tid", simulate.sampled(F.col("tpl"), default_model(), F.col("tid")).alias("read"))


@_query()
def polish_exact(spark, sf_dir):
    return polish.polish_exactly(*_draft_reads(spark, sf_dir), "tid", "draft", "rd")
