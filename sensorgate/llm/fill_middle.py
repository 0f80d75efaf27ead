"""Fill-in-the-middle examples by a regular expression with counted quantifiers.

A text is a run of units (lines). ``regexp_count`` gives their number n, two hashes of the document's id give the counts
a <= b, and a pattern made for the row, ``(unit{a})(unit{b - a})(rest)``, captures prefix, middle and suffix in one match;
its replacement writes them in the order of the form. The quantifiers are possessive: the engine steps from unit to unit
in a loop, so neither backtracking nor the stack grows with a text.

The output holds each marker once, since texts that contain one stay plain, and no marker can arise where a part meets a
marker: they share no character at their ends. So the places of the markers give the parts back.

Defined cases: a null text is an empty one; an empty text is plain; a null id is hashed as an empty string; repeated rows
(also of one id with different texts) are each cut by themselves; texts may be of any length; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm.common import query, table

#: A line with its end, or the last one without.
UNIT = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50


def draws(doc_id: Column | str, seed: int, count: int) -> list[Column]:
    """Unsigned 32-bit numbers: the first groups of eight digits of the sha256 of ``seed:id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")))
    digest = F.sha2(F.encode(key, "UTF-8"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def examples(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, text, n, form, output`` of each row. Of 100 texts ``rate`` are cut, and of 100 cut ones ``spm_rate`` have the suffix first."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"n": F.regexp_count("text", F.lit(UNIT)).cast("long"), "h": F.array(*draws("doc_id", seed, 4))})
    first, second = (F.col("h")[k] % (F.col("n") + 1) for k in (0, 1))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h")[2] % 100 >= rate), "plain").when(F.col("h")[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    counted = [F.concat(F.lit(f"((?:{UNIT}){{"), k.cast("string"), F.lit("}+)")) for k in (F.col("a"), F.col("b") - F.col("a"))]
    pattern = F.concat(F.lit(r"\A"), *counted, F.lit(r"([\s\S]*+)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    return rows.select("doc_id", "text", "n", "form", output.alias("output"))


def with_parts(rows: DataFrame) -> DataFrame:
    """Add ``prefix, middle, suffix, restored`` to ``output, form`` by the places of the markers, found once for each row.

    ``restored`` is the exact text again; the parts of plain texts are null.
    """
    size, spm = len(PREFIX), F.col("form") == "spm"
    second = F.when(spm, F.instr("output", PREFIX)).otherwise(F.instr("output", SUFFIX))
    rows = rows.withColumns({"_second": second, "_third": F.instr("output", MIDDLE)})
    cut = {
        "_one": F.expr(f"substring(output, {size + 1}, _second - {size + 1})"),
        "_two": F.expr(f"substring(output, _second + {size}, _third - _second - {size})"),
        "middle": F.expr(f"substring(output, _third + {size})"),
    }
    rows = rows.withColumns({name: F.when(F.col("form") != "plain", part) for name, part in cut.items()})
    rows = rows.withColumns({"prefix": F.when(spm, F.col("_two")).otherwise(F.col("_one")), "suffix": F.when(spm, F.col("_one")).otherwise(F.col("_two"))})
    return rows.withColumn("restored", F.coalesce(F.concat("prefix", "middle", "suffix"), "output")).drop("_one", "_two", "_second", "_third")


SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, ('0x' || d[1:8])::BIGINT AS h1,
    ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h
), c AS (
  SELECT doc_id, text, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), s AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(units[b + 1:n], ''), '') AS s FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""


@query("op11_fill_in_middle", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_parts(examples(table(spark, folder, "documents")).drop("text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        sha("output").alias("output_sha256"),
        sha("restored").alias("restored_sha256"),
    )
