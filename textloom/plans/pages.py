"""Text blocks from web pages, as input of the structure and chunking operators.

Paragraph k of a page gives a text block; every third is preceded by a heading
(numbered, deeper, in capitals in turn); every fourth also gives a bullet list
and every seventh a grid. Five paragraphs make a page. The headings, bullets
and grids are made here because the pages have hardly any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_blocks(pages: DataFrame) -> DataFrame:
    paras = F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode_outer(paras).alias("k", "html")).where("k is not null")
    k, text = F.col("k"), F.regexp_replace("html", r"<[^>]+>", "")
    title = (
        F.when(k % 9 == 0, F.concat(k + 1, F.lit(" Topic "), k))
        .when(k % 9 == 3, F.concat(F.lit("1."), k, F.lit(" Topic "), k))
        .otherwise(F.concat(F.lit("SECTION "), k))
    )
    bullets = F.concat(F.lit("- "), F.replace(text, F.lit(". "), F.lit(".\n- ")))
    grid = F.replace(F.replace(text, F.lit(". "), F.lit(".\n")), F.lit(" "), F.lit("  "))
    block = lambda n, when, value: F.when(when, F.struct((4 * k + n).alias("block_no"), value.alias("text")))
    blocks = F.array(block(0, k % 3 == 0, title), block(1, k % 4 == 1, bullets), block(2, k % 7 == 3, grid), block(3, F.lit(True), text))
    rows = rows.select("doc_id", (k / 5).cast("int").alias("page"), F.explode_outer(blocks).alias("b")).where("b is not null")
    return rows.select("doc_id", "b.block_no", "b.text", (F.col("page") + 1).alias("page"))


#: The same in DuckDB SQL, as a common table expression ``blocks``.
BLOCKS_SQL = r"""
paras AS (
  SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS h, generate_subscripts(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), 1) - 1 AS k
  FROM pages),
clean AS (SELECT doc_id, k, regexp_replace(h, '<[^>]+>', '', 'g') AS t FROM paras),
blocks AS (
  SELECT doc_id, (4 * k)::INT AS block_no,
         CASE WHEN k % 9 = 0 THEN (k + 1) || ' Topic ' || k WHEN k % 9 = 3 THEN '1.' || k || ' Topic ' || k ELSE 'SECTION ' || k END AS text,
         (k // 5 + 1)::INT AS page FROM clean WHERE k % 3 = 0
  UNION ALL SELECT doc_id, (4 * k + 1)::INT, '- ' || replace(t, '. ', '.' || chr(10) || '- '), (k // 5 + 1)::INT FROM clean WHERE k % 4 = 1
  UNION ALL SELECT doc_id, (4 * k + 2)::INT, replace(replace(t, '. ', '.' || chr(10)), ' ', '  '), (k // 5 + 1)::INT FROM clean WHERE k % 7 = 3
  UNION ALL SELECT doc_id, (4 * k + 3)::INT, t, (k // 5 + 1)::INT FROM clean)
"""
