"""Fill-in-the-middle: texts reordered as prefix, suffix and middle, by DuckDB SQL over Arrow batches.

Each batch of a task is registered with an in-process DuckDB, one SELECT cuts its texts, and the result goes
back as Arrow: no Python runs for a row. Where a text is cut and which form it takes follow from a hash of its
id alone, so reruns, retries and other partitionings give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import carried

#: Code points of a block. A text is a list of blocks; only the two blocks that hold a cut are split into code points.
BLOCK = 64


@dataclass(frozen=True)
class Forms:
    """Marks of the three parts, percentages of texts left plain and of others with the suffix first, and what the hash of ids begins with."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain: int = 10
    suffix_first: int = 20
    seed: str = "1:"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def statement(forms: Forms) -> str:
    """The SELECT over a view `batch` (i, id, text): one row for each of its rows, with i."""
    p, s, m = map(quoted, forms.marks)
    part = "('0x' || substr(h, {}, 8))::UBIGINT"
    whole = f"list_slice(b, 1, {{0}} // {BLOCK})"
    rest = f"list_slice(regexp_extract_all(coalesce(b[{{0}} // {BLOCK} + 1], ''), '(?s).'), 1, {{0}} % {BLOCK})"
    head = f"array_to_string({whole}, '') || array_to_string({rest}, '')"
    after = f"array_to_string(list_slice(regexp_extract_all(coalesce(b[{{0}} // {BLOCK} + 1], ''), '(?s).'), {{0}} % {BLOCK} + 1, {BLOCK}), '')"
    tail = f"{after} || array_to_string(list_slice(b, {{0}} // {BLOCK} + 2, len(b)), '')"
    # The middle is what the head up to the second cut has beyond the head up to the first; both are lists of whole blocks and code points.
    same = f"array_to_string(list_slice(regexp_extract_all(coalesce(b[lo // {BLOCK} + 1], ''), '(?s).'), lo % {BLOCK} + 1, hi % {BLOCK}), '')"
    apart = f"{after.format('lo')} || array_to_string(list_slice(b, lo // {BLOCK} + 2, hi // {BLOCK}), '') || array_to_string({rest.format('hi')}, '')"
    return f"""
      WITH hashed AS (
        SELECT i, coalesce(text, '') AS t, sha256({quoted(forms.seed)} || coalesce(id, '')) AS h FROM batch),
      drawn AS (
        SELECT i, t, length(t) AS n, {part.format(1)} AS h1, {part.format(9)} AS h2, {part.format(17)} AS h3, {part.format(25)} AS h4 FROM hashed),
      dealt AS (
        SELECT i, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi,
          CASE WHEN n = 0 OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR h3 % 100 >= {100 - forms.plain} THEN 'plain'
            WHEN h4 % 100 < {forms.suffix_first} THEN 'spm' ELSE 'psm' END AS form
        FROM drawn),
      blocks AS (
        SELECT i, t, n, lo, hi, form, CASE WHEN form <> 'plain' THEN regexp_extract_all(t, '(?s).{{1,{BLOCK}}}') END AS b FROM dealt),
      cut AS (
        SELECT i, t, n, form, lo, hi, {head.format('lo')} AS a, CASE WHEN lo // {BLOCK} = hi // {BLOCK} THEN {same} ELSE {apart} END AS m, {tail.format('hi')} AS z FROM blocks)
      SELECT i, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
        CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || a || {s} || z || {m} || m ELSE {s} || z || {p} || a || {m} || m END AS output
      FROM cut"""


FIELDS = (("n", pa.int64(), "long"), ("form", pa.string(), "string"), ("prefix_chars", pa.int64(), "long"), ("middle_chars", pa.int64(), "long"), ("output", pa.string(), "string"))


def transformed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", forms: Forms = Forms(), out: str = "infill") -> DataFrame:
    """docs with a struct out: n (code points), form, prefix_chars, middle_chars (null if plain), output (the text).

    h1 to h4 are the first four 8-digit groups of the hex SHA-256 of the seed and the id. The prefix ends after
    the smaller of h1 % (n + 1) and h2 % (n + 1) code points, the middle after the larger. A text is left plain if
    it is empty, holds one of the marks, or h3 % 100 falls in the plain share; of the others h4 % 100 decides
    whether the suffix stands first. Null texts are empty texts; a null id is hashed as an empty string. Rows with
    the same id are cut at the same draws. All other columns stay, whatever their names (one named like out is
    replaced). A batch in work holds its texts about four times; nothing is shuffled.
    """
    query, names = statement(forms), [f[0] for f in FIELDS]
    inner = ", ".join(f"{n} {t}" for n, _, t in FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                table = pa.table({"i": pa.array(range(batch.num_rows), pa.int64()), "id": batch.column("id"), "text": batch.column("text")})
                con.register("batch", table)
                got = con.sql(query).to_arrow_table()
                con.unregister("batch")
                got = got.take(pc.sort_indices(got["i"]))
                cols = [got[n].combine_chunks().cast(t) for n, t, _ in FIELDS]
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.StructArray.from_arrays(cols, names)], ["_row", "_out"])

    rows = carried(docs, F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kept = [c for c in docs.columns if c != out]
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, _out struct<{inner.replace(' ', ':').replace(',:', ',')}>"
    return rows.mapInArrow(run, schema).select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("_out").alias(out))


def restored(output: Column, form: Column, forms: Forms = Forms()) -> Column:
    """The text that an output of a form was made of: exact, as cut texts hold none of the marks."""
    parts = F.split(output, "|".join(map(re.escape, forms.marks)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


#: By plain substrings, apart from the lists of the operator.
ORACLE_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1) AS b,
    ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS d FROM hashed),
formed AS (
  SELECT *, least(a, b)::BIGINT AS lo, greatest(a, b)::BIGINT AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
