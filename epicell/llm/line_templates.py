"""Line deduplication by a log-template tree: lines that recur across documents as one template.

A line walks down a tree of fixed depth: number of tokens, then its leading tokens. In the leaf its
template keeps the constant tokens and replaces variable fields. A field is variable by its form
(digits, addresses), or because lines of the leaf agree in everything but one half of what follows the
leading tokens. Everything is built-in expressions; a template is known by the hash of its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicell.llm.common import col
from epicell.session import settle

# depth of the tree below the token count
LEADING = 2
# shorter lines are no templates; from the second length on, one half may vary
MIN_TOKENS = 4
MIN_VARIED_TOKENS = 16
# a template recurs when so many different texts hold it
MIN_TEXTS = 3
# a whole line of MIN_VARIED_TOKENS tokens or more says enough to recur in two texts, where that is asked for
MIN_LONG_TEXTS = 2
# so does a line without generalised keys from so many characters on: it may be of a script without blanks
LONG_CHARS = 100
FIELD = "<*>"
BLANKS = " \t\r"


def bare(line: Column) -> Column:
    """The trimmed line with single blanks between its tokens."""
    text = F.trim(line, F.lit(BLANKS))
    odd = F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t"))
    return F.when(odd, F.regexp_replace(text, "[ \t]+", " ")).otherwise(text)


def masked(text: Column) -> Column:
    """A bare line with every token that has a digit or an @ replaced by FIELD."""
    return F.when(text.rlike("[0-9@]"), F.regexp_replace(text, "(^| )[^ ]*[0-9@][^ ]*", "$1" + FIELD)).otherwise(text)


def token_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def template_keys(text: Column, n: Column) -> Column:
    """Keys of the templates of a masked line of n tokens: itself, and one for each half that may vary.

    Lines with too few tokens, or with more fields than constant tokens, have none.
    """
    fields = (F.length(text) - F.length(F.replace(text, F.lit(FIELD), F.lit("")))) / len(FIELD)
    half = F.floor((n - LEADING) / 2).cast("int")
    whole = F.xxhash64(F.lit(0), text)
    first_varies = F.xxhash64(F.lit(1), n, F.substring_index(text, " ", LEADING), _after(text, n - LEADING - half))
    second_varies = F.xxhash64(F.lit(2), n, _before(text, half + LEADING))
    # the lowest bit tells whole long lines apart, which may need fewer texts
    return (
        F.when((n < MIN_TOKENS) | (fields * 2 > n), F.array().cast("array<bigint>"))
        .when(n < MIN_VARIED_TOKENS, F.array(whole.bitwiseAND(F.lit(-2))))
        .otherwise(F.array(whole.bitwiseOR(F.lit(1)), first_varies.bitwiseAND(F.lit(-2)), second_varies.bitwiseAND(F.lit(-2))))
    )


def verbatim_key(line: Column, n: Column, keys: Column) -> Column:
    """The keys of a bare line; one that has none and is not empty gets a key of its own words, fields not replaced.

    Where there are keys, the one of the whole line already meets every verbatim repeat.
    """
    long = (n >= MIN_VARIED_TOKENS) | (F.length(line) >= LONG_CHARS)
    exact = F.xxhash64(F.lit(3), line)
    exact = F.when(long, exact.bitwiseOR(F.lit(1))).otherwise(exact.bitwiseAND(F.lit(-2)))
    return F.when((F.size(keys) == 0) & (line != ""), F.array(exact)).otherwise(keys)


def _before(text: Column, tokens: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(" "), tokens.cast("int"))


def _after(text: Column, tokens: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(" "), (-tokens).cast("int"))


def recurring_templates(
    texts: DataFrame, min_texts: int = MIN_TEXTS, min_long_texts: int | None = MIN_LONG_TEXTS, verbatim: bool = True
) -> DataFrame:
    """(template, text_hash): where recurring templates have to go, from (key, text_hash, text).

    Texts are counted, not rows: copies of a document are one text. Of each recurring template the text
    with the smallest key keeps its lines and is left out here; texts that share that key all keep
    them, and NULL keys come last. A template that a third of all texts hold is counted by
    (template, text) first; what recurs is written before it is joined back, so that the runtime splits the texts
    of such a template.
    """
    # explode() would have Spark test the size of the array first, and compute it all a second time;
    # columns come one after the other, so that each is computed once for a line
    lines = texts.select("key", "text_hash", F.explode_outer(F.split("text", "\n")).alias("line"))
    lines = lines.withColumn("bare", bare(F.col("line"))).withColumn("line", masked(F.col("bare")))
    lines = lines.withColumn("n", token_count(F.col("line")))
    if not verbatim:
        lines = lines.where(F.col("n") >= MIN_TOKENS)
    keyed = lines.withColumn("templates", template_keys(F.col("line"), F.col("n")))
    if verbatim:
        keyed = keyed.withColumn("templates", verbatim_key(F.col("bare"), F.col("n"), F.col("templates")))
    keys = keyed.select("key", "text_hash", F.explode_outer("templates").alias("template")).where(F.col("template").isNotNull())
    held = settle(keys.groupBy("template", "text_hash").agg(F.min("key").alias("first")), "templates")
    long = F.col("template").bitwiseAND(F.lit(1)) == 1
    needed = F.when(long, F.lit(min_texts if min_long_texts is None else min_long_texts)).otherwise(F.lit(min_texts))
    recurring = held.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("least")).where(F.col("texts") >= needed)
    places = held.join(settle(recurring.select("template", "least"), "recurring"), "template")
    return places.where(~F.col("first").eqNullSafe(F.col("least"))).select("template", "text_hash")


def drop_recurring_lines(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_texts: int = MIN_TEXTS,
    min_long_texts: int | None = MIN_LONG_TEXTS,
    verbatim: bool = True,
) -> DataFrame:
    """All rows and columns, lines of recurring templates taken out of `text`, and `dropped_lines`.

    A line goes when one of its templates occurs in at least `min_texts` different texts (a whole long line:
    `min_long_texts`) and this text is not the first of them, which keeps it: nothing vanishes from the corpus. If
    `verbatim`, a line that is too short for a template, or has too many fields, counts by its own words. Lines end at a line feed; what stays keeps
    its order and form. Copies of a document count as one text and are treated alike, also those
    with equal or NULL keys. A NULL text stays NULL and an empty one empty, both with 0 dropped lines; a text may become
    empty. A column `dropped_lines` is replaced. Whole texts are read, whatever their length.
    """
    names = [c for c in documents.columns if c != "dropped_lines"]
    rows = documents.select(*[col(c) for c in names], F.xxhash64(col(text).cast("string")).alias("llm_text_hash"))
    plain = rows.where(col(text).isNotNull()).select(col(key).alias("key"), F.col("llm_text_hash").alias("text_hash"), col(text).cast("string").alias("text"))
    gone = recurring_templates(plain, min_texts, min_long_texts, verbatim).groupBy("text_hash").agg(F.collect_set("template").alias("llm_gone"))
    # written first: both sides of the join are bare shuffles, so the runtime splits the copies of one text
    gone = settle(gone, "gone")
    joined = rows.join(gone.withColumnRenamed("text_hash", "llm_text_hash"), "llm_text_hash", "left")
    lines = F.split(col(text).cast("string"), "\n")
    # step by step over all lines, so that nothing is computed twice for a line
    prepared = F.transform(F.transform(lines, bare), lambda b: F.struct(b.alias("b"), masked(b).alias("m")))
    counted = F.transform(prepared, lambda x: F.struct(x["b"].alias("b"), x["m"].alias("m"), token_count(x["m"]).alias("n")))
    keys = F.transform(counted, lambda x: F.struct(x["b"].alias("b"), x["n"].alias("n"), template_keys(x["m"], x["n"]).alias("k")))
    keys = F.transform(keys, lambda x: verbatim_key(x["b"], x["n"], x["k"]) if verbatim else x["k"])
    kept = F.zip_with(lines, keys, lambda line, k: F.when(~F.coalesce(F.arrays_overlap(k, F.col("llm_gone")), F.lit(False)), line))
    joined = joined.withColumn("llm_kept", F.when(F.col("llm_gone").isNotNull(), F.array_compact(kept)))
    changed = F.when(F.col("llm_kept").isNotNull(), F.array_join("llm_kept", "\n")).otherwise(col(text))
    dropped = F.when(F.col("llm_kept").isNotNull(), F.size(lines) - F.size("llm_kept")).otherwise(F.lit(0))
    return joined.select(*[changed.alias(c) if c == text else col(c) for c in names], dropped.cast("int").alias("dropped_lines"))


def oracle_sql(min_texts: int = MIN_TEXTS, min_long_texts: int = MIN_LONG_TEXTS) -> str:
    """The same rows for DuckDB: templates are compared as text."""
    return f"""
WITH t AS (
  SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text
), l AS (
  SELECT text, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t
), m AS (
  SELECT text, doc_id, line_no, line, regexp_replace(trim(line, ' ' || chr(9) || chr(13)), '(^|[ \\t])[^ \\t]*[0-9@][^ \\t]*', '\\1{FIELD}', 'g') AS masked FROM l
), k AS (
  SELECT *, regexp_split_to_array(masked, '[ \\t]+') AS w FROM m
), s AS (
  SELECT *, len(w) AS n, (len(w) - {LEADING}) // 2 AS half, regexp_replace(trim(line, ' ' || chr(9) || chr(13)), '[ \t]+', ' ', 'g') AS bare,
    len(w) >= {MIN_TOKENS} AND (length(masked) - length(replace(masked, '{FIELD}', ''))) // {len(FIELD)} * 2 <= len(w) AS general FROM k
), keys AS (
  SELECT text, doc_id, line_no, '0 ' || array_to_string(w, ' ') AS template, n >= {MIN_VARIED_TOKENS} AS long FROM s WHERE general
  UNION ALL SELECT text, doc_id, line_no, '1 ' || n || ' ' || array_to_string(w[1:{LEADING}], ' ') || ' ' || array_to_string(w[half + {LEADING} + 1:], ' '), false
  FROM s WHERE general AND n >= {MIN_VARIED_TOKENS}
  UNION ALL SELECT text, doc_id, line_no, '2 ' || n || ' ' || array_to_string(w[1:{LEADING} + half], ' '), false FROM s WHERE general AND n >= {MIN_VARIED_TOKENS}
  UNION ALL SELECT text, doc_id, line_no, '3 ' || bare, n >= {MIN_VARIED_TOKENS} OR length(bare) >= {LONG_CHARS} FROM s WHERE NOT general AND bare <> ''
), r AS (
  SELECT template, count(DISTINCT text) AS texts, arg_min(text, doc_id) AS keeper FROM keys GROUP BY template
  HAVING count(DISTINCT text) >= CASE WHEN bool_or(long) THEN {min_long_texts} ELSE {min_texts} END
), gone AS (
  SELECT DISTINCT text, line_no FROM keys JOIN r USING (template) WHERE text <> keeper
), rest AS (
  SELECT l.text, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE gone.line_no IS NULL) AS kept, count(gone.line_no) AS dropped
  FROM l LEFT JOIN gone ON gone.text = l.text AND gone.line_no = l.line_no GROUP BY l.text
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(rest.kept, '') END AS text,
  CAST(coalesce(rest.dropped, 0) AS INTEGER) AS dropped_lines
FROM documents d LEFT JOIN rest ON rest.text = d.text
"""
