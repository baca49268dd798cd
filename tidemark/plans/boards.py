"""Daily boards: each order as a page with a section a flag, and a table of its lines by brand; the SQL has the rows before they were HTML."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import boards
from ..sources.tables import table
from .queries import query

_SQL = """WITH l AS (SELECT l_orderkey AS id, 'Flag ' || l_returnflag AS section, p_brand AS theme, lpad(l_partkey::VARCHAR, 6, '0') AS code, p_name || ' & Co' AS stock, (l_quantity * 1000)::BIGINT AS close, round(l_discount * 100 - 4, 0)::BIGINT AS rate, (l_linenumber * 1234)::BIGINT AS volume, l_linenumber, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 10 <> 3),
s AS (SELECT DISTINCT id, section FROM l)
SELECT id AS order_id, 'DESCRIPTION' AS kind, section, 0::BIGINT AS paragraph, section AS theme, NULL::DOUBLE AS theme_rate, NULL::VARCHAR AS stock, NULL::VARCHAR AS code, NULL::BIGINT AS close, NULL::DOUBLE AS change_rate, NULL::BIGINT AS volume, 'About ' || section || ' of ' || id AS text FROM s
UNION ALL SELECT id, 'SECTION_DETAIL', section, 1, section, NULL, NULL, NULL, NULL, NULL, NULL, '▷ More < of ' || section FROM s
UNION ALL SELECT id, 'THEME_STOCK', section, NULL, theme, length(theme) / 4.0::DOUBLE, stock, code, close, rate, volume, theme || chr(9) || printf('%+.2f', length(theme) / 4.0::DOUBLE) || '%' || chr(9) || stock || chr(9) || close || chr(9) || printf('%+d', rate) || '%' || chr(9) || volume FROM l
UNION ALL SELECT o_orderkey, 'DESCRIPTION', '테마시황', 0, 'Theme ' || o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, 'Theme ' || o_orderkey || ' : rises' FROM orders WHERE o_orderkey % 10 = 3
UNION ALL SELECT o_orderkey, 'SECTION_DETAIL', '테마시황', 1, '테마시황', NULL, NULL, NULL, NULL, NULL, NULL, 'A quiet day' FROM orders WHERE o_orderkey % 10 = 3"""


@query(_SQL)
def board_rows(spark, d):
    """Pages read back: sections, details and rows, with themes that span rows."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    # an order's lines come together once; what follows keeps to that
    l = table(spark, d, "lineitem").where("l_orderkey % 10 <> 3").join(p, F.col("l_partkey") == F.col("p_partkey")).repartition("l_orderkey")
    theme_rate = F.format_string("%+.2f%%", F.length("p_brand") / 4.0)
    n, first = F.count("*").over(Window.partitionBy("l_orderkey", "l_returnflag", "p_brand")), F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag", "p_brand").orderBy("l_linenumber", "l_partkey"))
    # end tags of cells are left out in every third order
    end = F.when(F.col("l_orderkey") % 3 == 0, "").otherwise("</td>")
    lead = F.concat(F.lit("<td rowspan="), F.col("n").cast("string"), F.lit("><a href='/Theme/ThemeDB/7'>"), F.col("p_brand"), F.lit("</a>"), end, F.lit("<td rowspan='"), F.col("n").cast("string"), F.lit("'>"), theme_rate, end)
    l = l.withColumn("n", n).withColumn("first", first)
    rate = F.round(F.col("l_discount") * 100 - 4, 0).cast("long")
    cells = F.concat(F.lit("<td><a href=\"/s?x=1&code="), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit("\">"), F.col("p_name"), F.lit(" &amp; Co</a>"), end, F.lit("<td>"), (F.col("l_quantity") * 1000).cast("long").cast("string"), end, F.lit("<td>"), F.format_string("%+d%%", rate), end, F.lit("<td>"), (F.col("l_linenumber") * 1234).cast("string"), end)
    row = F.concat(F.lit("<tr>"), F.when(F.col("first") == 1, lead).otherwise(""), cells)
    rows = l.select("l_orderkey", "l_returnflag", F.struct("p_brand", "l_linenumber", "l_partkey", row.alias("row")).alias("r")).groupBy("l_orderkey", "l_returnflag").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "").alias("rows"))
    flag, key = F.col("l_returnflag"), F.col("l_orderkey").cast("string")
    part = F.concat(F.lit("<div>- Flag "), flag, F.lit(" -<p>About Flag "), flag, F.lit(" of "), key, F.lit("<p>▷ More &lt; of  Flag "), flag, F.lit("</div><table><tr><th>테마명<th>등락률<th>종목명</tr>"), F.col("rows"), F.lit("</table>"))
    html = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", part.alias("part")))), lambda x: x["part"]), "").alias("html")).select(F.col("l_orderkey").alias("page_id"), "html")
    quiet = table(spark, d, "orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("<p>Theme "), F.col("o_orderkey").cast("string"), F.lit(" : rises<br>A quiet&nbsp;day")).alias("html"))
    r = boards.relations(html.unionByName(quiet))
    return r.select(F.col("page_id").alias("order_id"), "kind", "section", F.col("paragraph").cast("long").alias("paragraph"), "theme", F.col("theme_rate").cast("double").alias("theme_rate"), "stock", "code", "close", F.col("change_rate").cast("double").alias("change_rate"), "volume", "text")
