"""Named queries over the driver's tables and the SQL each one must agree with.

The tables hold no pairs of truth and prediction, so pairs are made of them: a document against itself with every second
line break removed ("rewrapped"), and each turn of a conversation against the next. Boxes come from the integers of lineitem.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import metrics as M
from quirefold.functions import naming as N
from quirefold.functions import prompts as P
from quirefold.functions import text as X
from quirefold.operators import converters, evaluate, fewshot, layout, summary
from quirefold.plans import runs

SPLIT_SEED, SPLIT_RATIO = 13, 0.1
MODEL = "gemini/some-model:1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rewrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lang, gt, prediction)."""
    docs = table(spark, sf_dir, "documents")
    pieces = F.split("text", "\n")
    pairs = F.transform(pieces, lambda x, i: F.concat(F.when(i == 0, F.lit("")).when(i % 2 == 1, F.lit("\n")).otherwise(F.lit(" ")), x))
    return docs.select(F.col("doc_id").cast("string").alias("id"), "lang", F.col("text").alias("gt"), F.array_join(pairs, "").alias("prediction"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, role, gt, prediction): a turn and the next one of its conversation."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    joined = c.join(after, ["conv_id", "turn"])
    return joined.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", F.col("text").alias("gt"), "prediction")


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y1 = (F.col("l_linenumber") * 40 + F.col("l_partkey") % 37).cast("int")
    x1 = (F.col("l_suppkey") % 900).cast("int")
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("pos"), y1.alias("y1"), x1.alias("x1"), (x1 + 50 + F.col("l_quantity").cast("int")).alias("x2"), (y1 + 5 + F.col("l_partkey") % 41).cast("int").alias("y2"))


BOX_SQL = """
SELECT l_orderkey AS page, CAST(l_linenumber AS INTEGER) AS pos, CAST(l_linenumber * 40 + l_partkey % 37 AS INTEGER) AS y1, CAST(l_suppkey % 900 AS INTEGER) AS x1,
  CAST(l_suppkey % 900 AS INTEGER) + 50 + CAST(floor(l_quantity) AS INTEGER) AS x2, CAST(l_linenumber * 40 + l_partkey % 37 + 5 + l_partkey % 41 AS INTEGER) AS y2
FROM lineitem
"""
LINES = r"list_transform(string_split(trim({c}, ' ' || chr(10)), chr(10)), lambda x: trim(x))"
PRED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (CASE WHEN i = 1 THEN '' WHEN i % 2 = 0 THEN chr(10) ELSE ' ' END) || x), '')"
ARRAYS = f"SELECT doc_id, lang, CASE WHEN trim(text, ' ' || chr(10)) = '' THEN [] ELSE {LINES.format(c='text')} END AS r, CASE WHEN trim(p, ' ' || chr(10)) = '' THEN [] ELSE {LINES.format(c='p')} END AS h FROM (SELECT doc_id, lang, text, {PRED} AS p FROM documents)"


def _accuracy_sql(r: str, h: str) -> str:
    same = f"list_sum(list_transform(range(1, greatest(len({r}), len({h})) + 1), lambda i: CASE WHEN coalesce({r}[i], '') = coalesce({h}[i], '') THEN 1 ELSE 0 END))"
    return f"CASE WHEN len({r}) = 0 AND len({h}) = 0 THEN 1.0 WHEN len({r}) = 0 THEN 0.0 ELSE {same} / greatest(len({r}), len({h})) END"


def tokens_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_words"), F.md5(X.normalize(F.col("text")).cast("binary")).alias("norm_md5"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", X.lines(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "|").cast("binary")).alias("lines_md5"))


def cer_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("id", F.round(M.cer(F.col("gt"), F.col("prediction")), 6).alias("cer"))


def wer_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("id", F.round(M.wer(F.col("gt"), F.col("prediction")), 6).alias("wer"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


#: Pairs of turns with their line arrays, word arrays and texts. DuckDB's levenshtein counts bytes, so the letters beyond ASCII of the
#: table (up to 26) become control signs, one for each; word distances are the rows of the table of edit distances, one row a step.
TURNS_SQL = r"""
WITH RECURSIVE letters AS (
  SELECT coalesce(string_agg(ch, '' ORDER BY ch), '') AS alpha FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM conversations) WHERE ord(ch) > 127
), pairs AS (
  SELECT c.conv_id || '-' || c.turn AS id, c.role, c.text AS gt, n.text AS prediction, trim(c.text, ' ' || chr(10)) AS r, trim(n.text, ' ' || chr(10)) AS h
  FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
), p AS (
  SELECT *, list_filter(regexp_split_to_array(r, '\s+'), lambda x: x <> '') AS rw, list_filter(regexp_split_to_array(h, '\s+'), lambda x: x <> '') AS hw,
    CASE WHEN r = '' THEN [] ELSE list_transform(string_split(r, chr(10)), lambda x: trim(x)) END AS rl,
    CASE WHEN h = '' THEN [] ELSE list_transform(string_split(h, chr(10)), lambda x: trim(x)) END AS hl
  FROM pairs
), steps AS (
  SELECT id, rw, hw, 0 AS i, range(0, len(hw) + 1) AS d FROM p
  UNION ALL
  SELECT id, rw, hw, i, list_transform(range(0, len(hw) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: t[k + 1] - k))) FROM (
    SELECT id, rw, hw, i + 1 AS i, list_transform(range(0, len(hw) + 1), lambda k: CASE WHEN k = 0 THEN d[1] + 1 ELSE least(d[k + 1] + 1, d[k] + CASE WHEN hw[k] = rw[i + 1] THEN 0 ELSE 1 END) END) AS t
    FROM steps WHERE i < len(rw)
  )
), words AS (SELECT id, d[len(hw) + 1] AS distance FROM steps WHERE i = len(rw)),
single AS (
  SELECT p.*, translate(r, alpha, signs) AS rs, translate(h, alpha, signs) AS hs,
    translate(array_to_string(rw, ' '), alpha, signs) AS rn, translate(array_to_string(hw, ' '), alpha, signs) AS hn
  FROM p, letters, (SELECT string_agg(chr(CAST(k AS INTEGER)), '' ORDER BY k) AS signs FROM range(1, 32) t(k) WHERE k < 9 OR k > 13)
)
"""


def _rate_sql(distance: str, r: str, h: str, size: str = "length") -> str:
    return f"CASE WHEN {size}({r}) = 0 THEN (CASE WHEN {size}({h}) = 0 THEN 0.0 ELSE 1.0 END) ELSE {distance} / {size}({r}) END"


def _metrics_sql(legacy: bool = False, extra: str = "", digits: int | None = 6) -> str:
    """SELECT of evaluation rows after TURNS_SQL."""
    bare = "list_transform({c}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
    shown = (lambda e: f"round({e}, {digits})") if digits else (lambda e: e)
    wer = _rate_sql("w.distance", "rw", "hw", "len")
    columns = {"wer": wer, "cer": _rate_sql("levenshtein(rs, hs)", "rs", "hs"), "wer_norm": wer, "cer_norm": _rate_sql("levenshtein(rn, hn)", "rn", "hn")}
    for name, r, h in (("line_acc", "{}", "{}"), ("rev_line_acc", "list_reverse({})", "list_reverse({})")):
        columns[name] = _accuracy_sql(r.format("rl"), h.format("hl"))
        columns[f"{name}_norm"] = _accuracy_sql(r.format("rln"), h.format("hln"))
    if not legacy:
        for suffix, r, h in (("", "rl", "hl"), ("_norm", "rln", "hln")):
            hits = f"coalesce(list_sum(list_transform(list_distinct({r}), lambda x: least(len(list_filter({r}, lambda y: y = x)), len(list_filter({h}, lambda y: y = x))))), 0)"
            columns[f"exact_line_precision{suffix}"] = f"CASE WHEN len({h}) > 0 THEN {hits} / len({h}) ELSE 0.0 END"
            columns[f"exact_line_recall{suffix}"] = f"CASE WHEN len({r}) > 0 THEN {hits} / len({r}) ELSE 0.0 END"
            columns[f"exact_line_f1{suffix}"] = f"CASE WHEN {hits} > 0 THEN 2.0 * {hits} / (len({r}) + len({h})) ELSE 0.0 END"
    gt, prediction = ("r", "h") if legacy else ("gt", "prediction")
    sized = f"s.id, CAST(length({gt}) AS INTEGER) AS len_gt, CAST(length({prediction}) AS INTEGER) AS len_pred"
    return f"SELECT {extra}{sized}, " + ", ".join(f"{shown(e)} AS {c}" for c, e in columns.items()) + f" FROM (SELECT *, {bare.format(c='rl')} AS rln, {bare.format(c='hl')} AS hln FROM single) s JOIN words w ON w.id = s.id"


def _line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrapped(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), "lang", X.lines(F.col("gt")).alias("r"), X.lines(F.col("prediction")).alias("h"))


def line_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _line_arrays(spark, sf_dir).withColumns({"rn": F.transform("r", X.normalize), "hn": F.transform("h", X.normalize)})
    r, h, rn, hn = (F.col(c) for c in ("r", "h", "rn", "hn"))
    return a.select("doc_id", F.round(M.line_accuracy(r, h), 6).alias("line_acc"), F.round(M.line_accuracy(rn, hn), 6).alias("line_acc_norm"))


def rev_line_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _line_arrays(spark, sf_dir).withColumns({"rn": F.transform("r", X.normalize), "hn": F.transform("h", X.normalize)})
    r, h, rn, hn = (F.col(c) for c in ("r", "h", "rn", "hn"))
    return a.select("doc_id", F.round(M.reverse_line_accuracy(r, h), 6).alias("rev_line_acc"), F.round(M.reverse_line_accuracy(rn, hn), 6).alias("rev_line_acc_norm"))


def exact_line_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _line_arrays(spark, sf_dir).withColumn("hits", M.line_hits(F.col("r"), F.col("h")))
    p, r, f1 = M.prf(F.col("hits"), F.size("r"), F.size("h"))
    return a.select("doc_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def exact_line_prf_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _line_arrays(spark, sf_dir).select("doc_id", F.transform("r", X.normalize).alias("r"), F.transform("h", X.normalize).alias("h"))
    a = a.withColumn("hits", M.line_hits(F.col("r"), F.col("h")))
    p, r, f1 = M.prf(F.col("hits"), F.size("r"), F.size("h"))
    return a.select("doc_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluation_rows(turn_pairs(spark, sf_dir)))


def eval_rows_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluation_rows(turn_pairs(spark, sf_dir), legacy=True))


def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.evaluation_rows(turn_pairs(spark, sf_dir), extra=("role",))
    return _rounded(evaluate.macro_average(rows, by=("role",)))


def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.micro_prf(rewrapped(spark, sf_dir), "gt", "prediction", by=("lang",))
    return m.select("lang", F.col("hits").cast("long").alias("hits"), "lines_ref", "lines_hyp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as of one evaluation file per source and language, with macro rows."""
    docs = table(spark, sf_dir, "documents")
    file = F.concat("source", F.lit("_eval_"), "lang")
    rows = docs.select(file.alias("file"), F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("string").alias("len_gt"), (F.col("n_chars") % 97 / 97).alias("wer"), (F.col("n_chars") % 89 / 89).alias("cer"))
    macro = rows.groupBy("file").agg(F.lit("macro_avg").alias("id"), F.lit("").alias("len_gt"), F.round(F.avg("wer"), 6).alias("wer"), F.round(F.avg("cer"), 6).alias("cer"))
    return rows.unionByName(macro)


def summary_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary_long(_result_rows(spark, sf_dir))


def summary_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary_wide(summary.summary_long(_result_rows(spark, sf_dir)), ["de", "en", "es", "fr"])


RESULT_SQL = """
WITH r AS (SELECT source || '_eval_' || lang AS file, source, lang, n_chars % 97 / 97.0 AS wer, n_chars % 89 / 89.0 AS cer FROM documents),
l AS (SELECT source AS dataset, lang AS method, file, count(*) AS n_samples, CAST(NULL AS DOUBLE) AS len_gt, round(avg(wer), 6) AS wer, round(avg(cer), 6) AS cer FROM r GROUP BY source, lang, file)
"""


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return evaluate.not_processed(docs, table(spark, sf_dir, "labels"), ["doc_id"])


def _inclusion(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        gt = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("gt"))
        transcription = docs.where("n_chars >= 200").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", " ").alias("transcription"))
        ocr = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("ocr"))
        images = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.array("url").alias("images"))
        found = evaluate.method_inputs(method, gt, transcription, ocr, images)
        return found.select("id", F.coalesce("ocr", F.lit("-")).alias("ocr"), F.size("images").alias("n_images"))

    return query


def _inclusion_sql(method: str) -> str:
    base = "FROM documents d JOIN documents t ON t.doc_id = d.doc_id AND t.n_chars >= 200 "
    pages = "JOIN pages p ON p.page_id = d.doc_id "
    if method == "m1":
        return f"SELECT d.doc_id AS id, '-' AS ocr, CAST(1 AS INTEGER) AS n_images {base}{pages}"
    if method == "m2":
        return f"SELECT d.doc_id AS id, coalesce('q' || l.quality, '') AS ocr, CAST(1 AS INTEGER) AS n_images {base}{pages} LEFT JOIN labels l ON l.doc_id = d.doc_id"
    return f"SELECT d.doc_id AS id, 'q' || l.quality AS ocr, CAST(0 AS INTEGER) AS n_images {base} JOIN labels l ON l.doc_id = d.doc_id"


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("pages", (1 + F.floor(F.col("n_chars") / 2000)).cast("int"))
    return layout.explode_made(docs, ["doc_id"], layout.split_pages(F.col("text"), F.col("pages")), "page", "chunk")


#: From each cut the next one is the first word that would pass the target, found by the places where words end.
PAGE_SPLIT_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, trim(text, ' ' || chr(10)) AS text, CAST(1 + floor(n_chars / 2000) AS INTEGER) AS pages, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents
), many AS (SELECT * FROM d WHERE pages > 1 AND len(w) > 0),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM many),
c AS (SELECT *, ends - length(word) AS begins, lag(ends) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM (SELECT *, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i) + i AS ends FROM x)),
s AS (
  SELECT doc_id, 0 AS page, CAST(0 AS BIGINT) AS b, CAST(0 AS HUGEINT) AS begins, CAST(max(ends) AS DOUBLE) AS rest, any_value(pages) AS left_ FROM c JOIN many USING (doc_id) GROUP BY doc_id
  UNION ALL
  SELECT s.doc_id, any_value(s.page) + 1, min(c.i), min(c.begins), any_value(s.rest) - CAST(min(c.before) - any_value(s.begins) AS DOUBLE), any_value(s.left_) - 1
  FROM s JOIN c ON c.doc_id = s.doc_id AND c.i > s.b AND c.ends - s.begins > s.rest / s.left_ WHERE s.left_ > 1 GROUP BY s.doc_id
), spans AS (SELECT *, lead(b) OVER (PARTITION BY doc_id ORDER BY page) AS e FROM s),
full_ AS (SELECT spans.doc_id, page, string_agg(word, ' ' ORDER BY i) AS chunk FROM spans JOIN x ON x.doc_id = spans.doc_id AND i >= b AND (e IS NULL OR i < e) GROUP BY ALL),
places AS (SELECT doc_id, CAST(unnest(range(pages)) AS INTEGER) AS page FROM many)
SELECT places.doc_id, places.page, coalesce(chunk, '') AS chunk FROM places LEFT JOIN full_ ON full_.doc_id = places.doc_id AND full_.page = places.page
UNION ALL SELECT doc_id, 0, text FROM d WHERE pages <= 1 OR len(w) = 0
"""


def page_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken apart to lines, ten to a page, and put together again."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("string").alias("id"), X.lines(F.col("text")).alias("l"))
    lines = layout.explode_made(docs, ["id"], F.col("l"), "n", "text")
    lines = lines.select("id", F.floor(F.col("n") / 10).cast("int").alias("page"), (F.col("n") % 10).alias("line_index"), "text")
    out = layout.assemble(lines)
    return out.select("id", F.md5(F.col("ocr").cast("binary")).alias("ocr_md5"), "num_pages", F.col("num_lines").cast("long").alias("num_lines"))


def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = raw_boxes(spark, sf_dir)
    out = b.groupBy("page").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    padded = G.pad(F.struct("x1", "y1", "x2", "y2"), 10)
    return out.select("page", *[padded[k].alias(k) for k in ("x1", "y1", "x2", "y2")])


def _page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = raw_boxes(spark, sf_dir)
    return b.groupBy("page").agg(F.collect_list(F.struct("y1", "x1", "pos", "x2", "y2")).alias("boxes"))


def line_merge_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = layout.merge_lines(_page_boxes(spark, sf_dir), "boxes")
    return layout.explode_made(merged, ["page"], F.col("lines"), "line_index", "b").select("page", "line_index", "b.*")


def _merge_sql(kept: str, joins: str, tail: str) -> str:
    """Boxes taken one after the other, each into the running line or to a new one. kept: (page, k, x1, y1, x2, y2, ...) with k from 1."""
    gap = "CASE WHEN s.y2 <= n.y1 THEN n.y1 - s.y2 WHEN n.y2 <= s.y1 THEN s.y1 - n.y2 ELSE -1 END"
    overlap = "CASE WHEN least(s.y2, n.y2) <= greatest(s.y1, n.y1) OR least(s.y2 - s.y1, n.y2 - n.y1) <= 0 THEN 0.0 ELSE (least(s.y2, n.y2) - greatest(s.y1, n.y1)) / least(s.y2 - s.y1, n.y2 - n.y1) END"
    same = joins.format(overlap=overlap, gap=gap)
    return f"""
    WITH RECURSIVE b AS ({BOX_SQL}), {kept},
    s AS (
      SELECT page, k, 1 AS line, x1, y1, x2, y2 FROM kept WHERE k = 1
      UNION ALL
      SELECT page, k, CASE WHEN same THEN line ELSE line + 1 END, CASE WHEN same THEN least(sx1, x1) ELSE x1 END, CASE WHEN same THEN least(sy1, y1) ELSE y1 END, CASE WHEN same THEN greatest(sx2, x2) ELSE x2 END, CASE WHEN same THEN greatest(sy2, y2) ELSE y2 END
      FROM (SELECT n.page, n.k, s.line, n.x1, n.y1, n.x2, n.y2, s.x1 AS sx1, s.y1 AS sy1, s.x2 AS sx2, s.y2 AS sy2, {same} AS same FROM s JOIN kept n ON n.page = s.page AND n.k = s.k + 1)
    ), m AS (SELECT page, line, arg_max(x1, k) AS x1, arg_max(y1, k) AS y1, arg_max(x2, k) AS x2, arg_max(y2, k) AS y2 FROM s GROUP BY page, line)
    {tail}"""


ADAPTIVE_KEPT = """
r AS (SELECT page, CAST(CASE WHEN count(*) >= 4 THEN list_sort(list(y2 - y1))[count(*) * 3 // 4 + 1] ELSE list_sort(list(y2 - y1))[count(*) // 2 + 1] END AS INTEGER) AS ref FROM b GROUP BY page),
kept AS (SELECT b.*, ref, CAST(row_number() OVER (PARTITION BY b.page ORDER BY y1, x1, pos, x2, y2) AS INTEGER) AS k FROM b JOIN r ON r.page = b.page WHERE y2 - y1 > CAST(floor(ref * 0.2) AS INTEGER)),
g AS (SELECT page, CASE WHEN y2 <= ny1 THEN ny1 - y2 WHEN ny2 <= y1 THEN y1 - ny2 ELSE -1 END AS gap FROM (SELECT page, y1, y2, lead(y1) OVER w AS ny1, lead(y2) OVER w AS ny2 FROM kept WINDOW w AS (PARTITION BY page ORDER BY k)) WHERE ny1 IS NOT NULL),
most AS (SELECT r.page, ref, least(CAST(floor(ref * 0.5) AS INTEGER), coalesce(CAST(floor(list_sort(list(gap) FILTER (WHERE gap >= 0))[count(gap) FILTER (WHERE gap >= 0) // 2 + 1] * 0.3) AS INTEGER), 2147483647)) AS most FROM r LEFT JOIN g ON g.page = r.page GROUP BY r.page, ref)"""
ADAPTIVE_TAIL = """, tall AS (SELECT m.*, ref FROM m JOIN r ON r.page = m.page WHERE y2 - y1 >= CAST(floor(ref * 0.3) AS INTEGER)),
highest AS (SELECT page, line, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y2 - y1 DESC, line) AS n FROM m) WHERE n = 1 AND page NOT IN (SELECT page FROM tall)),
bare AS (SELECT page, 1 AS line, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y2 - y1 DESC, y1, x1, pos) AS n FROM b WHERE page NOT IN (SELECT page FROM kept)) WHERE n = 1),
found AS (SELECT page, line, x1, y1, x2, y2 FROM tall UNION ALL SELECT * FROM highest UNION ALL SELECT * FROM bare)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y1, x1, x2, y2) - 1 AS INTEGER) AS line_index, x1, y1, x2, y2 FROM found"""


def line_merge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _page_boxes(spark, sf_dir).withColumn("lines", layout.merge_same_line(F.col("boxes"), F.lit(600)))
    return layout.explode_made(pages, ["page"], F.col("lines"), "line_index", "b").select("page", "line_index", "b.*")


def line_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.number_lines(raw_boxes(spark, sf_dir).drop("pos")).select("page", "line_index", "y1", "x1", "x2", "y2", "gap")


def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = line_numbering(spark, sf_dir).where("gap >= 0")
    return numbered.groupBy("page").agg(F.count(F.lit(1)).alias("n_gaps"), G.upper_order_statistic(F.collect_list("gap")).alias("median_gap"))


def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = raw_boxes(spark, sf_dir).groupBy("page").agg(F.collect_list(F.col("y2") - F.col("y1")).alias("h"))
    return b.select("page", G.upper_order_statistic(F.col("h"), 3, 4).alias("upper_quartile"), G.upper_order_statistic(F.col("h")).alias("upper_median"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", N.hash_bucket(key, SPLIT_SEED).alias("bucket"), N.in_validation(key, SPLIT_RATIO, SPLIT_SEED).alias("is_val"))


BUCKET_SQL = "list_reduce(list_transform(string_split(sha1('13:' || {key}), ''), lambda d: strpos('0123456789abcdef', d) - 1), lambda a, d: (a * 16 + d) % 1000)"


def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("source").alias("writer"), F.col("doc_id").cast("string").alias("image_path"), "text")
    s = converters.manifest_stats(converters.manifest(lines, min_words=1))
    return s.select("part", "count", F.round("avg_words", 6).alias("avg_words"), F.round("avg_chars", 6).alias("avg_chars"), "writers")


def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stem = F.when(F.col("n_chars") % 4 == 0, F.concat("source", F.lit("_eval_"), "lang")).when(F.col("n_chars") % 4 == 1, F.concat(F.lit("evaluation_m2_"), "source")).when(F.col("n_chars") % 4 == 2, F.concat(F.lit("evaluation_"), "lang")).otherwise(F.col("source"))
    d = docs.select("doc_id", stem.alias("stem")).withColumn("n", N.result_file(F.col("stem")))
    return d.select("doc_id", "stem", "n.dataset", "n.method")


STEM_SQL = "CASE n_chars % 4 WHEN 0 THEN source || '_eval_' || lang WHEN 1 THEN 'evaluation_m2_' || source WHEN 2 THEN 'evaluation_' || lang ELSE source END"


def coded_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each document written as codes and decoded again."""
    plain = X.normalize(F.regexp_replace("text", "[^A-Za-z,.]", " "))
    coded = F.array_join(F.transform(F.split(plain, " "), lambda w: F.replace(F.replace(F.regexp_replace(w, "(?<=.)(?=.)", "-"), F.lit(","), F.lit("s_cm")), F.lit("."), F.lit("s_pt"))), "|")
    d = table(spark, sf_dir, "documents").select("doc_id", coded.alias("coded"))
    return d.select("doc_id", F.md5(N.decode_line(F.col("coded")).cast("binary")).alias("text_md5"))


def _example(spark: SparkSession, sf_dir: str):
    return F.array(F.struct(F.lit("a").alias("sample_id"), F.lit("one\ntwo").alias("gt_text"), F.lit("one two").alias("transcription"), F.lit("ome\ntwo").alias("ocr_text"), F.array().cast("array<string>").alias("image_paths")))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ex = _example(spark, sf_dir)
    text, flat = F.col("text"), F.regexp_replace("text", "\n", " ")
    md5 = lambda c: F.md5(c.cast("binary"))
    return docs.select("doc_id", md5(P.render("m1", flat)).alias("m1"), md5(P.render("m2", flat, text, ex)).alias("m2"), md5(P.render("m3", flat, text, ex)).alias("m3"))


def _prompt_sql() -> str:
    example = P.EXAMPLE_HEAD + "Example 1:\n" + "".join(f"{label}{value}\n\n" for (label, _), value in zip(P.EXAMPLE_PARTS["m3"], ("one two", "ome\ntwo", "one\ntwo"), strict=True)) + P.EXAMPLE_FOOT

    def literal(method: str, shown: str) -> str:
        template = P.TEMPLATES[method].replace("{examples}", shown)
        quoted = "'" + template.replace("'", "''").replace("{transcription}", "' || replace(text, chr(10), ' ') || '").replace("{htr}", "' || text || '") + "'"
        return f"md5({quoted}) AS {method}"

    return f"SELECT doc_id, {literal('m1', '')}, {literal('m2', example)}, {literal('m3', example)} FROM documents"


def fewshot_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return fewshot.hashed_examples(ids, 2, 42)


def fewshot_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return fewshot.ring_examples(ids, 3, 42)


def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_matrix(spark, MODEL)


def intersect_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lambda c: _line_arrays(spark, sf_dir).select(F.explode(c).alias("line"))
    return evaluate.multiset_lines(lines("r"), lines("h")).groupBy(F.md5(F.col("line").cast("binary")).alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


def model_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.element_at(F.array(F.lit("openai"), F.lit("HF"), F.lit("other")), (F.col("n_nationkey") % 3 + 1).cast("int")), F.lit("/"), F.col("n_name"))
    n = table(spark, sf_dir, "nation").select(model.alias("model_id")).withColumn("p", N.provider(F.col("model_id")))
    name = N.checkpoint_name(F.lit("m1"), F.lit("data/sets/one"), F.col("model_id"), F.lit(2))
    return n.select("model_id", F.col("p.provider").alias("provider"), F.col("p.model").alias("model"), name.alias("checkpoint"))


def batch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    batches = li.groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("loss"), F.count(F.lit(1)).alias("n"))
    return batches.groupBy("l_returnflag").agg(F.round(evaluate.weighted_mean(F.col("loss"), F.col("n")), 6).alias("mean_loss"))


def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("loss", F.length("n_name"))
    return evaluate.best_so_far(n, "n_nationkey", "loss").select("n_nationkey", "loss", "is_best")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        tokens_norm, split_lines, cer_turns, wer_turns, line_acc, rev_line_acc, exact_line_prf, exact_line_prf_norm, eval_rows, eval_rows_legacy,
        eval_macro, micro_prf, summary_long, summary_wide, resume_anti_join, page_split, page_assemble, bbox_union, line_merge_adaptive, line_merge_overlap,
        line_numbering, gap_stats, order_stats, hash_split, split_stats, filename_parse, coded_decode, prompt_render, fewshot_pool, fewshot_ring, run_matrix,
        intersect_all_lines, model_parse, batch_means, best_so_far,
    )
    found = {f.__name__: f for f in plain}
    return found | {f"method_inclusion_{m}": _inclusion(m) for m in runs.METHODS}


def _prf_sql(arrays: str, keys: str = "doc_id") -> str:
    return f"""
    WITH a AS ({arrays}), x AS (SELECT doc_id, unnest(r) AS l FROM a), y AS (SELECT doc_id, unnest(h) AS l FROM a),
    cx AS (SELECT doc_id, l, count(*) AS n FROM x GROUP BY ALL), cy AS (SELECT doc_id, l, count(*) AS n FROM y GROUP BY ALL),
    k AS (SELECT cx.doc_id, sum(least(cx.n, cy.n)) AS hits FROM cx JOIN cy ON cx.doc_id = cy.doc_id AND cx.l = cy.l GROUP BY ALL),
    d AS (SELECT a.doc_id, a.lang, coalesce(k.hits, 0) AS hits, len(r) AS nr, len(h) AS nh FROM a LEFT JOIN k ON k.doc_id = a.doc_id)
    """


_SCORES = """round(CASE WHEN nh > 0 THEN hits / nh ELSE 0 END, 6) AS precision, round(CASE WHEN nr > 0 THEN hits / nr ELSE 0 END, 6) AS recall,
round(CASE WHEN hits > 0 THEN 2 * (hits / nh) * (hits / nr) / (hits / nh + hits / nr) ELSE 0 END, 6) AS f1"""


def oracle_sql() -> dict[str, str]:
    norm = "list_transform({c}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
    normed = f"SELECT doc_id, lang, {norm.format(c='r')} AS r, {norm.format(c='h')} AS h FROM ({ARRAYS})"
    acc = f"SELECT doc_id, round({_accuracy_sql('r', 'h')}, 6) AS line_acc, round({_accuracy_sql('rn', 'hn')}, 6) AS line_acc_norm FROM (SELECT *, {norm.format(c='r')} AS rn, {norm.format(c='h')} AS hn FROM ({ARRAYS}))"
    rev = f"SELECT doc_id, round({_accuracy_sql('r', 'h')}, 6) AS rev_line_acc, round({_accuracy_sql('rn', 'hn')}, 6) AS rev_line_acc_norm FROM (SELECT doc_id, list_reverse(r) AS r, list_reverse(h) AS h, list_reverse({norm.format(c='r')}) AS rn, list_reverse({norm.format(c='h')}) AS hn FROM ({ARRAYS}))"
    named = "CASE WHEN regexp_matches(stem, '^.+?_eval_.+$') THEN regexp_extract(stem, '^(.+?)_eval_(.+)$', {a}) WHEN regexp_matches(stem, '^evaluation_m[123]_.+$') THEN regexp_extract(stem, '^evaluation_(m[123])_(.+)$', {b}) WHEN starts_with(stem, 'evaluation_') THEN {c} ELSE {d} END"
    found = {
        "tokens_norm": r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm_md5 FROM documents",
        "split_lines": f"SELECT doc_id, CAST(len(r) AS INTEGER) AS n_lines, md5(array_to_string(r, '|')) AS lines_md5 FROM ({ARRAYS})",
        "cer_turns": TURNS_SQL + f"SELECT id, round({_rate_sql('levenshtein(rs, hs)', 'rs', 'hs')}, 6) AS cer FROM single",
        "wer_turns": TURNS_SQL + f"SELECT p.id, round({_rate_sql('w.distance', 'rw', 'hw', 'len')}, 6) AS wer FROM p JOIN words w ON w.id = p.id",
        "eval_rows": TURNS_SQL + _metrics_sql(),
        "eval_rows_legacy": TURNS_SQL + _metrics_sql(legacy=True),
        "eval_macro": TURNS_SQL + f", e AS ({_metrics_sql(extra='role, ', digits=None)}) SELECT role, 'macro_avg' AS id, CAST(NULL AS INTEGER) AS len_gt, CAST(NULL AS INTEGER) AS len_pred, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in M.METRICS) + ", count(*) AS n_docs FROM e GROUP BY role",
        "page_split": PAGE_SPLIT_SQL,
        "line_merge_adaptive": _merge_sql(ADAPTIVE_KEPT, "({overlap} >= 0.4 OR {gap} BETWEEN 0 AND (SELECT most FROM most WHERE most.page = n.page))", ADAPTIVE_TAIL),
        "line_merge_overlap": _merge_sql("kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY y1, x1, pos, x2, y2) AS INTEGER) AS k FROM b WHERE y2 - y1 >= 12)", "({overlap} >= 0.3)", "SELECT page, CAST(line - 1 AS INTEGER) AS line_index, x1, y1, x2, y2 FROM m"),
        "line_acc": acc,
        "rev_line_acc": rev,
        "exact_line_prf": _prf_sql(ARRAYS) + f"SELECT doc_id, {_SCORES} FROM d",
        "exact_line_prf_norm": _prf_sql(normed) + f"SELECT doc_id, {_SCORES} FROM d",
        "micro_prf": _prf_sql(ARRAYS) + f", g AS (SELECT lang, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(nr) AS BIGINT) AS nr, CAST(sum(nh) AS BIGINT) AS nh FROM d GROUP BY lang) SELECT lang, hits, nr AS lines_ref, nh AS lines_hyp, {_SCORES} FROM g",
        "summary_long": RESULT_SQL + "SELECT * FROM l",
        "summary_wide": RESULT_SQL + "SELECT dataset, " + ", ".join(f"max(CASE WHEN method = '{m}' THEN {v} END) AS {m}_{v}" for v in ("wer", "cer") for m in ("de", "en", "es", "fr")) + " FROM l GROUP BY dataset",
        "resume_anti_join": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "page_assemble": f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(range(len(r))) AS n, unnest(r) AS t FROM ({ARRAYS})),
            p AS (SELECT id, n // 10 AS page, trim(string_agg(t, chr(10) ORDER BY n), ' ' || chr(10)) AS t, count(*) AS k FROM l GROUP BY ALL)
            SELECT id, md5(coalesce(trim(string_agg(t, chr(10) || chr(10) ORDER BY page) FILTER (WHERE t <> ''), ' ' || chr(10)), '')) AS ocr_md5, count(*) AS num_pages, CAST(sum(k) AS BIGINT) AS num_lines FROM p GROUP BY id""",
        "bbox_union": f"SELECT page, greatest(min(x1) - 10, 0) AS x1, greatest(min(y1) - 10, 0) AS y1, max(x2) + 10 AS x2, max(y2) + 10 AS y2 FROM ({BOX_SQL}) GROUP BY page",
        "order_stats": f"SELECT page, list_sort(h)[len(h) * 3 // 4 + 1] AS upper_quartile, list_sort(h)[len(h) // 2 + 1] AS upper_median FROM (SELECT page, list(y2 - y1) AS h FROM ({BOX_SQL}) GROUP BY page)",
        "hash_split": f"SELECT c_custkey, CAST(b AS INTEGER) AS bucket, b < 100 AS is_val FROM (SELECT c_custkey, {BUCKET_SQL.format(key='c_custkey')} AS b FROM customer)",
        "split_stats": f"""WITH d AS (SELECT *, CASE WHEN {BUCKET_SQL.format(key='source')} < 100 THEN 'val' ELSE 'train' END AS part, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)
            SELECT v.part, count(d.doc_id) AS count, round(coalesce(avg(w), 0.0), 6) AS avg_words, round(coalesce(avg(length(text)), 0.0), 6) AS avg_chars, count(DISTINCT source) AS writers
            FROM (VALUES ('train'), ('val')) v(part) LEFT JOIN d ON d.part = v.part AND d.w >= 1 GROUP BY v.part""",
        "filename_parse": f"SELECT doc_id, stem, {named.format(a=1, b=2, c=chr(39) + 'evaluation' + chr(39), d='stem')} AS dataset, {named.format(a=2, b=1, c='substr(stem, 12)', d=chr(39) + 'unknown' + chr(39))} AS method FROM (SELECT doc_id, {STEM_SQL} AS stem FROM documents)",
        "coded_decode": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^A-Za-z,.]', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM documents",
        "prompt_render": _prompt_sql(),
        "fewshot_pool": """WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS id, md5('42:' || doc_id) AS d FROM documents), t AS (SELECT * FROM p ORDER BY d LIMIT 3),
            j AS (SELECT p.id, t.id AS sample_id, CAST(row_number() OVER (PARTITION BY p.id ORDER BY t.d) - 1 AS INTEGER) AS position FROM p JOIN t ON p.id <> t.id) SELECT * FROM j WHERE position < 2""",
        "fewshot_ring": """WITH p AS (SELECT id, md5('42:' || id) AS d FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents)),
            r AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS place, count(*) OVER () AS n FROM p)
            SELECT r.id, CAST(k AS INTEGER) AS position, s.id AS sample_id FROM r CROSS JOIN range(0, 3) AS t(k) JOIN r AS s ON s.place = (r.place + k + 1) % r.n WHERE k < r.n - 1""",
        "intersect_all_lines": f"WITH a AS ({ARRAYS}), k AS (SELECT unnest(r) AS line FROM a INTERSECT ALL SELECT unnest(h) AS line FROM a) SELECT md5(line) AS line_md5, count(*) AS n FROM k GROUP BY line",
        "model_parse": """WITH m AS (SELECT ['openai', 'HF', 'other'][CAST(n_nationkey % 3 + 1 AS INTEGER)] || '/' || n_name AS model_id FROM nation)
            SELECT model_id, CASE split_part(model_id, '/', 1) WHEN 'openai' THEN 'openai' ELSE 'hf' END AS provider, CASE WHEN starts_with(model_id, 'other') THEN model_id ELSE split_part(model_id, '/', 2) END AS model,
              'checkpoint_m1_one_' || translate(model_id, '/:', '__') || '_2shot.json' AS checkpoint FROM m""",
        "batch_means": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_loss FROM lineitem GROUP BY l_returnflag",
        "best_so_far": "SELECT n_nationkey, CAST(length(n_name) AS INTEGER) AS loss, coalesce(length(n_name) < min(length(n_name)) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best FROM nation",
        "run_matrix": """SELECT method, dataset, CAST(n_shots AS INTEGER) AS n_shots, 'gemini/some-model:1' AS model, dataset || '_eval_' || method || '_' || n_shots || 'shot_gemini_some-model_1.csv' AS output,
            'checkpoint_' || method || '_' || dataset || '_gemini_some-model_1_' || n_shots || 'shot.json' AS checkpoint
            FROM (VALUES ('m1'), ('m2'), ('m3')) a(method), (VALUES ('bullinger_handwritten'), ('bullinger_print'), ('easy_historical'), ('IAM_handwritten'), ('IAM_print'), ('children_handwritten')) b(dataset), (VALUES (0), (1), (2)) c(n_shots)""",
    }
    gap = "CASE WHEN ny1 IS NULL THEN NULL WHEN y2 <= ny1 THEN ny1 - y2 WHEN ny2 <= y1 THEN y1 - ny2 ELSE -1 END"
    window = "WINDOW w AS (PARTITION BY page ORDER BY y1, x1, x2, y2)"
    numbered = f"SELECT page, line_index, y1, x1, x2, y2, {gap} AS gap FROM (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS line_index, lead(y1) OVER w AS ny1, lead(y2) OVER w AS ny2 FROM ({BOX_SQL}) {window})"
    found["line_numbering"] = numbered
    found["gap_stats"] = f"SELECT page, count(*) AS n_gaps, list_sort(list(gap))[count(*) // 2 + 1] AS median_gap FROM ({numbered}) WHERE gap >= 0 GROUP BY page"
    return found | {f"method_inclusion_{m}": _inclusion_sql(m) for m in runs.METHODS}
