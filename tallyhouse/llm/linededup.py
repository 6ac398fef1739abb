r"""Line deduplication with a log-template tree of fixed depth.

A line's words lead it through the tree: first their number, then its first
``DEPTH`` words, words with a digit counting as ``<*>``.  Inside a leaf a word is
constant at its place if documents with at least ``MIN_DOCS`` different texts have
it there; words with a digit are fields that match anything, other places are
variable.  The constants and their places are the line's template, if they are at
least ``CONSTANT`` percent of its words without a digit, and at least ``MIN_FIXED``
where it has words with one.  A template found in ``MIN_DOCS`` different texts
recurs: its lines are dropped from all texts but that of the document with the smallest
doc_id.

A line of ``LONG`` words or more is a template of its own too, its whole wording being
constant: such a passage recurs as soon as two different texts have it.

Exact copies of a document count once, so they aren't taken for boilerplate, and lose or
keep the same lines, so they stay copies.  Only
DataFrame functions are used; lines travel as hashes, and only lines of leaves that
recur are looked at word by word, once for each different line and not for each copy.

Defined results: a null text stays null and has no lines; blank lines (no words) are
never dropped; a document with a null doc_id counts but its text never keeps a template by
itself (where no bearer has a doc_id, all keep it);
repeated rows are judged alike; an empty table gives no rows; other columns pass
``drop_lines`` and ``keep_distinct`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import BLANK_CHARACTERS, SPACE, small, stored

DEPTH, MIN_DOCS, CONSTANT, MIN_FIXED, LONG, MIN_LONG = 3, 8, 80, 2, 50, 2
VARIABLE = "<*>"
_IN_WORD = r"[^\x20\x09-\x0D]"
#: A word with a digit; it is tried at the beginnings of words only, so long words take linear time.
DIGIT_WORD = rf"(?<!{_IN_WORD})[^\x20\x09-\x0D0-9]*+[0-9]{_IN_WORD}*"


def text_key() -> Column:
    return F.xxhash64("text")


def _words(line: str | Column) -> Column:
    return F.array_remove(F.split(line, SPACE + "+"), "")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, same (the text's hash), place, masked line, leaf, whole and shape for each line with a word.

    ``shape`` stands for the masked words; long lines have a second row with ``whole`` and the
    hash of their own words.
    """
    lines = docs.where("text is not null").select("doc_id", text_key().alias("same"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.where(F.btrim("line", F.lit(BLANK_CHARACTERS)) != "")  # cheaper than to split each line once more for this
    digit = F.col("line").rlike("[0-9]")
    masked = F.when(digit, F.regexp_replace("line", DIGIT_WORD, VARIABLE)).otherwise(F.col("line"))
    lines = lines.withColumn("masked", masked).withColumn("words", _words("masked"))
    leaf = F.xxhash64(F.size("words"), F.slice("words", 1, DEPTH))
    template = F.struct(F.lit(False).alias("whole"), F.xxhash64("words").alias("shape"))
    own = F.struct(F.lit(True).alias("whole"), F.xxhash64(F.when(digit, _words("line")).otherwise(F.col("words")), F.lit("whole")).alias("shape"))
    kinds = F.when(F.size("words") >= LONG, F.array(template, own)).otherwise(F.array(template))
    return lines.select("doc_id", "same", "place", "masked", leaf.alias("leaf"), F.explode(kinds).alias("kind")).select("doc_id", "same", "place", "masked", "leaf", "kind.whole", "kind.shape")


def _constants(found: DataFrame, distinct: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(tokens: leaf, shape, at, word; those of them that are constants: leaf, at, word).

    A word has at least as many different texts as the shape with the most of them, and at
    most the sum over its shapes; only between those two bounds are its texts counted.
    """
    tokens = stored(distinct.select("leaf", "shape", "texts", F.posexplode(_words("masked")).alias("at", "word")), "line-tokens")
    bounds = tokens.where(F.col("word") != VARIABLE).groupBy("leaf", "at", "word").agg(F.max("texts").alias("least"), F.sum("texts").alias("most"))
    bounds = stored(bounds.where(F.col("most") >= min_docs), "line-bounds")
    open_ = bounds.where(F.col("least") < min_docs).select("leaf", "at", "word")
    texts = found.where("not whole").select("leaf", "shape", "same").distinct()
    counted = tokens.join(small(open_), ["leaf", "at", "word"]).select("leaf", "shape", "at", "word").join(texts, ["leaf", "shape"])
    counted = counted.groupBy("leaf", "at", "word").agg(F.count_distinct("same").alias("n")).where(F.col("n") >= min_docs)
    often = bounds.where(F.col("least") >= min_docs).select("leaf", "at", "word").unionByName(counted.select("leaf", "at", "word"))
    return tokens, stored(often, "line-constants")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, constant: int = CONSTANT) -> DataFrame:
    """Lines of recurring templates: doc_id, same, place, template, keeper (the text that keeps it)."""
    shapes = lines_of(docs).select("leaf", "whole", "shape", "same").distinct().groupBy("leaf", "whole", "shape").agg(F.count("*").alias("texts"))
    shapes = stored(shapes, "line-shapes")
    leaves = shapes.where("not whole").groupBy("leaf").agg(F.sum("texts").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    candidates = shapes.where("not whole").join(leaves, "leaf").unionByName(shapes.where("whole").where(F.col("texts") >= MIN_LONG))
    candidates = stored(candidates.select("leaf", "shape", "texts"), "line-candidates")
    found = lines_of(docs).join(small(candidates), ["leaf", "shape"])
    found = stored(found.select("doc_id", "same", "place", "leaf", "whole", "shape", "texts", F.when(~F.col("whole"), F.col("masked")).alias("masked")), "line-found")
    distinct = found.where("not whole").groupBy("leaf", "shape").agg(F.first("texts").alias("texts"), F.min("masked").alias("masked"))
    tokens, often = _constants(found, distinct, min_docs)
    marked = tokens.join(small(often.withColumn("fixed", F.lit(True)), row_bytes=96), ["leaf", "at", "word"], "left")
    fixed = F.collect_list(F.when(F.col("fixed"), F.struct("at", "word")))
    templates = marked.groupBy("leaf", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("word") == VARIABLE).alias("fields"), F.array_sort(fixed).alias("fixed"))
    n_fixed = F.size("fixed")
    enough = (100 * n_fixed >= constant * (F.col("n") - F.col("fields"))) & (n_fixed >= F.when(F.col("fields") > 0, MIN_FIXED).otherwise(1))
    templates = templates.where(enough).select("leaf", "shape", F.xxhash64("leaf", "fixed").alias("template"))
    matched = found.where("not whole").join(small(templates), ["leaf", "shape"]).select("doc_id", "same", "place", "template")
    whole = found.where("whole").select("doc_id", "same", "place", F.xxhash64("leaf", "shape").alias("template"))
    matched = stored(matched.withColumn("least", F.lit(min_docs)).unionByName(whole.withColumn("least", F.lit(MIN_LONG))), "line-matched")
    texts = matched.select("template", "same", "least").distinct().groupBy("template").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "same")))
    keepers = matched.groupBy("template").agg(first.alias("first")).select("template", F.col("first.same").alias("keeper"))
    keepers = stored(keepers.join(texts.select("template"), "template"), "line-keepers")
    return matched.drop("least").join(small(keepers), "template")


def _left(docs: DataFrame, min_docs: int, constant: int) -> DataFrame:
    """row (all of the document's columns), left (its text without the lines that went) and gone (their places)."""
    away = recurring(docs, min_docs, constant).where("same <> keeper")
    away = stored(away.groupBy(F.col("doc_id").alias("id"), "same").agg(F.sort_array(F.collect_set("place")).alias("gone")), "line-gone")
    own = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    joined = own.join(small(away, row_bytes=128), F.col("doc_id").eqNullSafe(F.col("id")) & (text_key() == F.col("same")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return joined.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("left"), "gone")


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, constant: int = CONSTANT) -> DataFrame:
    """``docs`` with recurring lines taken out of text, and dropped (array of the places of lines that went) in place of a column of that name."""
    own = [F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "dropped"]
    return _left(docs, min_docs, constant).select(*own, F.coalesce("gone", F.array().cast("array<int>")).alias("dropped"))


def keep_distinct(docs: DataFrame, min_docs: int = MIN_DOCS, constant: int = CONSTANT) -> DataFrame:
    """``docs`` with its own columns and recurring lines taken out of text; a document that lost lines and has no word left goes."""
    some = F.col("gone").isNull() | (F.translate("left", BLANK_CHARACTERS, "") != "")
    own = [F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return _left(docs, min_docs, constant).where(some).select(*own)


def line_sql(min_docs: int = MIN_DOCS, constant: int = CONSTANT) -> str:
    """The digests of ``drop_lines`` in DuckDB SQL."""
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
split AS (
  SELECT row, doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM texts WHERE text IS NOT NULL),
cut AS (
  SELECT row, doc_id, text, place, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS plain FROM split),
lines AS MATERIALIZED (
  SELECT *, (len(words)::VARCHAR || ' ' || array_to_string(words[1:{DEPTH}], ' ')) AS leaf, array_to_string(words, ' ') AS shape, array_to_string(plain, ' ') AS wording
  FROM (SELECT *, list_transform(plain, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{VARIABLE}' ELSE w END) AS words FROM cut WHERE len(plain) > 0)),
often AS (
  SELECT leaf, spot, word FROM (SELECT leaf, text, unnest(words) AS word, unnest(range(len(words))) AS spot FROM lines)
  WHERE word <> '{VARIABLE}' GROUP BY leaf, spot, word HAVING count(DISTINCT text) >= {min_docs}),
shapes AS MATERIALIZED (SELECT leaf, shape, any_value(words) AS words FROM lines GROUP BY leaf, shape),
tokens AS (SELECT leaf, shape, unnest(words) AS word, unnest(range(len(words))) AS spot FROM shapes),
templates AS (
  SELECT t.leaf, t.shape, t.leaf || ':' || coalesce(string_agg(o.spot::VARCHAR || ' ' || o.word, ' ' ORDER BY o.spot) FILTER (WHERE o.spot IS NOT NULL), '') AS template
  FROM tokens t LEFT JOIN often o ON o.leaf = t.leaf AND o.spot = t.spot AND o.word = t.word
  GROUP BY t.leaf, t.shape
  HAVING 100 * count(o.spot) >= {constant} * count(*) FILTER (WHERE t.word <> '{VARIABLE}')
     AND count(o.spot) >= CASE WHEN count(*) FILTER (WHERE t.word = '{VARIABLE}') > 0 THEN {MIN_FIXED} ELSE 1 END),
matched AS MATERIALIZED (
  SELECT l.row, l.doc_id, l.text, l.place, t.template, {min_docs} AS least FROM lines l JOIN templates t ON t.leaf = l.leaf AND t.shape = l.shape
  UNION ALL SELECT row, doc_id, text, place, 'whole ' || wording, {MIN_LONG} FROM lines WHERE len(plain) >= {LONG}),
known AS (SELECT template, arg_min(text, doc_id) AS keeper FROM matched GROUP BY template HAVING count(DISTINCT text) >= max(least)),
gone AS (SELECT DISTINCT m.row, m.place FROM matched m JOIN known k ON k.template = m.template WHERE m.text <> k.keeper),
told AS (
  SELECT s.row, count(*) AS n_lines, count(g.place) AS n_dropped, coalesce(string_agg(s.line, chr(10) ORDER BY s.place) FILTER (WHERE g.place IS NULL), '') AS left_text
  FROM split s LEFT JOIN gone g ON g.row = s.row AND g.place = s.place GROUP BY s.row)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       CAST(length(coalesce(left_text, '')) AS BIGINT) AS n_chars, sha256(coalesce(left_text, '')) AS text_sha256
FROM texts LEFT JOIN told USING (row)"""
