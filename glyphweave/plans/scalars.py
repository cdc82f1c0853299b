"""Scalar functions over the text and address columns of the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import text as T
from ..functions.cites import cites_column
from .registry import query

LIN = "lin AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL)"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text")


@query("F-01", r"SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key FROM conversations WHERE text IS NOT NULL")
def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.normalised(F.col("text")).alias("key"))


@query("F-02", r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM conversations WHERE text IS NOT NULL")
def title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.title_key(F.col("text")).alias("key"))


@query("F-03", "SELECT conv_id, turn, CASE WHEN trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'c' || conv_id ELSE trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM conversations WHERE text IS NOT NULL")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.slug(F.col("text"), F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("slug"))


@query("F-05", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL")
def md_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.markdown_normalised(F.col("text")).alias("text"))


@query("F-53", r"SELECT conv_id, turn, regexp_replace(replace(text, '\', '\\'), '([`*~\[\]<>])', '\\\1', 'g') AS text, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1) AS fence FROM conversations WHERE text IS NOT NULL AND NOT contains(text, '_')")
def md_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir).filter(~F.contains("text", F.lit("_")))
    return rows.select("conv_id", "turn", T.markdown_escaped(F.col("text")).alias("text"), T.fence_size(F.col("text")).alias("fence"))


@query("F-53")
def md_escape_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As md_escape, over every text; its SQL can't tell which underscores are escaped."""
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.markdown_escaped(F.col("text")).alias("text"), T.fence_size(F.col("text")).alias("fence"))


@query("F-50", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages WHERE html IS NOT NULL")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", T.html_escaped(F.col("html")).alias("escaped"))


_URIS = """u AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'javascript:' || url WHEN 2 THEN '#sec-' || page_id WHEN 3 THEN 'img/p' || page_id || '.png' WHEN 4 THEN '../up/' || page_id WHEN 5 THEN ' ' || replace(url, '&', '&amp;') || ' ' WHEN 6 THEN url || ' x' ELSE 'data:image/png;base64,QUJD' || page_id || '=' END AS uri FROM pages)"""
_HREF = r"""trim(replace(replace(replace(replace(replace(uri, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'))"""
_SAFE = r"""CASE WHEN h <> '' AND NOT regexp_matches(h, '[\x00-\x20\x7f]') AND (regexp_matches(h, '^#[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]+$') OR NOT starts_with(h, '#') AND lower(regexp_extract(h, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto', 'tel')) THEN h END"""


def _uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    i, url, n = F.col("page_id") % 8, F.col("url"), F.col("page_id").cast("string")
    uri = (
        F.when(i == 0, url).when(i == 1, F.concat(F.lit("javascript:"), url)).when(i == 2, F.concat(F.lit("#sec-"), n)).when(i == 3, F.concat(F.lit("img/p"), n, F.lit(".png")))
        .when(i == 4, F.concat(F.lit("../up/"), n)).when(i == 5, F.concat(F.lit(" "), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit(" "))).when(i == 6, F.concat(url, F.lit(" x")))
        .otherwise(F.concat(F.lit("data:image/png;base64,QUJD"), n, F.lit("=")))
    )
    return pages.select("page_id", uri.alias("uri"))


@query("F-51 S-17", f"WITH {_URIS}, h AS (SELECT page_id, {_HREF} AS h FROM u) SELECT page_id, {_SAFE} AS href FROM h")
def safe_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uris(spark, sf_dir).select("page_id", T.safe_href(F.col("uri")).alias("href"))


@query(
    "F-51 S-41",
    rf"""WITH {_URIS}, h AS (SELECT page_id, {_HREF} AS h FROM u)
    SELECT page_id, coalesce({_SAFE}, CASE WHEN regexp_matches(h, '^data:image/(png|jpeg|jpg|gif|webp|svg\+xml);base64,[A-Za-z0-9+/=]+$') THEN h END,
      CASE WHEN h <> '' AND NOT regexp_matches(h, '[\x00-\x20\x7f]') AND NOT regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(h, '^[/\\~#]') AND NOT regexp_matches('/' || h || '/', '/\.{{1,2}}/') AND regexp_matches(h, '^[A-Za-z0-9._~@%+/-]+$') THEN h END) AS asset FROM h""",
)
def asset_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uris(spark, sf_dir).select("page_id", T.safe_asset(F.col("uri")).alias("asset"))


@query(
    "F-11 F-12",
    """WITH m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '(' || p_partkey || ')' WHEN 1 THEN repeat('x', cast(p_partkey % 4 AS INT)) || 'iv' WHEN 2 THEN chr(cast(97 + p_partkey % 26 AS INT)) || '.' WHEN 3 THEN 'MCM' || repeat('X', cast(p_partkey % 3 AS INT)) ELSE '[' || chr(cast(65 + p_partkey % 26 AS INT)) || 'b]' END AS label FROM part),
    b AS (SELECT p_partkey, label, trim(regexp_replace(regexp_replace(trim(label), '^[\\[(]\\s*', ''), '\\s*[\\]).]+$', '')) AS marker FROM m),
    r AS (SELECT *, CASE WHEN regexp_matches(marker, '^[ivxlcdmIVXLCDM]+$') THEN list_transform(range(1, length(marker) + 1), lambda i: CASE lower(substr(marker, i, 1)) WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END) END AS worth FROM b)
    SELECT p_partkey, marker, CASE WHEN regexp_matches(marker, '^[+-]?[0-9]+$') THEN 'decimal' WHEN regexp_matches(marker, '^[IVXLCDM]{2,}$') THEN 'upper-roman' WHEN regexp_matches(marker, '^[ivxlcdm]{2,}$') THEN 'lower-roman' WHEN regexp_matches(marker, '^[A-Z]$') THEN 'upper-alpha' WHEN regexp_matches(marker, '^[a-z]$') THEN 'lower-alpha' ELSE 'disc' END AS style,
      CASE WHEN NOT regexp_matches(marker, '^[A-Za-z]+$') THEN 0 WHEN length(marker) = 1 THEN ascii(lower(marker)) - 96 ELSE cast(list_sum(list_transform(range(1, length(marker) + 1), lambda i: (ascii(lower(substr(marker, i, 1))) - 96) * power(26, length(marker) - i))) AS BIGINT) END AS alpha,
      CASE WHEN worth IS NULL THEN 0 ELSE cast(list_sum(list_transform(range(1, len(worth) + 1), lambda i: CASE WHEN worth[i] < coalesce(list_max(worth[i + 1:]), 0) THEN -worth[i] ELSE worth[i] END)) AS BIGINT) END AS roman
    FROM r""".replace("\\\\", "\\"),
)
def roman_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    i, s = k % 5, k.cast("string")
    label = (
        F.when(i == 0, F.concat(F.lit("("), s, F.lit(")"))).when(i == 1, F.concat(F.repeat(F.lit("x"), (k % 4).cast("int")), F.lit("iv"))).when(i == 2, F.concat(F.char(97 + k % 26), F.lit(".")))
        .when(i == 3, F.concat(F.lit("MCM"), F.repeat(F.lit("X"), (k % 3).cast("int")))).otherwise(F.concat(F.lit("["), F.char(65 + k % 26), F.lit("b]")))
    )
    m = T.list_label(F.col("label"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).select("p_partkey", m.alias("marker"), T.marker_style(F.col("label")).alias("style"), T.alpha_value(m).alias("alpha"), T.roman_value(m).alias("roman"))


@query(
    "F-63 F-13 D-32",
    r"""WITH l AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN '- ' || text WHEN 1 THEN '  ' || turn || '. ' || text WHEN 2 THEN '    - [x] ' || text WHEN 3 THEN 'b. [ ] ' || text ELSE text END AS line FROM conversations WHERE text IS NOT NULL AND NOT contains(text, chr(10))),
    p AS (SELECT *, '^( *)(-|[0-9]+\.|[A-Za-z]+\.)(?:\s+\[([ xX])\])?\s+(.*)$' AS pat FROM l), i AS (SELECT *, regexp_matches(line, '^( *)(-|[0-9]+\.|[A-Za-z]+\.)(?:\s+\[([ xX])\])?\s+(.*)$') AS item FROM p)
    SELECT conv_id, turn, CASE WHEN item THEN 'item' ELSE 'continuation' END AS kind, CASE WHEN item THEN length(regexp_extract(line, '^( *)', 1)) END AS indent, CASE WHEN item THEN regexp_extract(line, '^ *(-|[0-9]+\.|[A-Za-z]+\.)', 1) <> '-' END AS ordered,
      CASE WHEN item THEN regexp_replace(regexp_extract(line, '^ *(-|[0-9]+\.|[A-Za-z]+\.)', 1), '\.$', '') END AS marker, CASE WHEN item THEN regexp_matches(line, '^ *(-|[0-9]+\.|[A-Za-z]+\.)\s+\[[ xX]\]\s') END AS task, CASE WHEN item THEN regexp_matches(line, '^ *(-|[0-9]+\.|[A-Za-z]+\.)\s+\[[xX]\]\s') END AS checked,
      trim(CASE WHEN item THEN regexp_extract(line, '^( *)(-|[0-9]+\.|[A-Za-z]+\.)(?:\s+\[([ xX])\])?\s+(.*)$', 4) ELSE line END) AS content FROM i""",
)
def list_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir).filter(~F.contains("text", F.lit("\n")))
    return rows.select("conv_id", "turn", T.list_record(_list_line(F.col("text"))).alias("r")).select("conv_id", "turn", "r.*")


def _list_line(t: Column) -> Column:
    k = (F.col("conv_id") + F.col("turn")) % 5
    return (
        F.when(k == 0, F.concat(F.lit("- "), t)).when(k == 1, F.concat(F.lit("  "), F.col("turn").cast("string"), F.lit(". "), t)).when(k == 2, F.concat(F.lit("    - [x] "), t))
        .when(k == 3, F.concat(F.lit("b. [ ] "), t)).otherwise(t)
    )


def _turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "text"))


@query("F-63 F-13 D-32")
def list_records_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As list_records, over every line of every turn."""
    return _turn_lines(spark, sf_dir).select("conv_id", "turn", "i", T.list_record(_list_line(F.col("text"))).alias("r")).select("conv_id", "turn", "i", "r.*")


@query(
    "F-63 D-33",
    r"""WITH l AS (SELECT conv_id, turn, repeat('> ', cast((conv_id + turn) % 4 AS INT)) || CASE WHEN turn % 3 = 0 THEN '```' ELSE text END AS line FROM conversations WHERE text IS NOT NULL AND NOT contains(text, chr(10)) AND NOT starts_with(text, '>'))
    SELECT conv_id, turn, length(replace(regexp_extract(line, '^((?:> ?)*)', 1), ' ', '')) AS depth, regexp_matches(trim(regexp_replace(line, '^((?:> ?)*)', '')), '^(`{3,}|~{3,})') AS fence FROM l""",
)
def quote_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(_conversations(spark, sf_dir).filter(~F.contains("text", F.lit("\n")) & ~F.startswith("text", F.lit(">"))))


def _quotes(rows: DataFrame) -> DataFrame:
    line = F.concat(F.repeat(F.lit("> "), ((F.col("conv_id") + F.col("turn")) % 4).cast("int")), F.when(F.col("turn") % 3 == 0, "```").otherwise(F.col("text")))
    content = F.trim(F.regexp_replace(line, r"^((?:> ?)*)", ""))
    return rows.select(*[c for c in rows.columns if c != "text"], T.quote_depth(line).alias("depth"), content.rlike(r"^(`{3,}|~{3,})").alias("fence"))


@query("F-63 D-33")
def quote_records_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As quote_records, over every line of every turn, quotes among them."""
    return _quotes(_turn_lines(spark, sf_dir))


_ROWS = "'| ' || coalesce(p_name, '') || ' | ' || CASE WHEN p_partkey % 4 = 0 THEN 'a \\| b' ELSE p_brand END || ' | ' || p_size || ' |'"


@query("F-64 F-63", f"SELECT p_partkey, list_transform(regexp_extract_all(replace({_ROWS}, '\\|', chr(1)), '[^|]+'), lambda c: trim(replace(c, chr(1), '|')))[1:3] AS cells, CASE p_partkey % 3 WHEN 0 THEN ['left', 'right'] WHEN 1 THEN ['center', ''] END AS aligned FROM part")
def gfm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    second = F.when(k % 4 == 0, F.lit("a \\| b")).otherwise(F.col("p_brand"))
    row = F.concat(F.lit("| "), F.coalesce("p_name", F.lit("")), F.lit(" | "), second, F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    rule = F.when(k % 3 == 0, F.lit("| :--- | ---: |")).when(k % 3 == 1, F.lit("| :---: | --- |")).otherwise(F.lit("| a | b |"))
    return table(spark, sf_dir, "part").select("p_partkey", T.gfm_cells(row).alias("cells"), T.gfm_alignments(rule).alias("aligned"))


@query("F-07 F-06", "SELECT p_partkey, CASE WHEN p_name = p_type THEN 0.0 ELSE cast(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type)) END AS ratio FROM part")
def levenshtein_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name against its type."""
    return table(spark, sf_dir, "part").select("p_partkey", T.edit_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query("F-07 F-06")
def levenshtein_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation against the one before, whole texts of any script; a first turn and a null text count as empty."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", before.alias("before"))
    whole = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("conv_id", "turn", "role", F.coalesce(T.edit_ratio(whole("before"), whole("text")), F.lit(0.0)).alias("ratio"))


@query(
    "F-66 D-70 A-15",
    """WITH f AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Btn' WHEN 'F' THEN 'Ch' ELSE 'Tx' END AS ft, (o_custkey * 4099 + o_orderkey * 65537) % 33554432 AS flags FROM orders)
    SELECT o_orderkey, CASE ft WHEN 'Btn' THEN CASE WHEN flags & 65536 <> 0 THEN 'pushbutton' WHEN flags & 32768 <> 0 THEN 'radio' ELSE 'checkbox' END WHEN 'Ch' THEN CASE WHEN flags & 131072 <> 0 THEN 'combo' ELSE 'listbox' END ELSE 'text' END AS kind,
      flags & 1 <> 0 AS readonly, flags & 2 <> 0 AS required, flags & 4096 <> 0 AS multiline, CASE WHEN flags & 8192 <> 0 THEN '[redacted]' ELSE cast(flags AS varchar) END AS value FROM f""",
)
def field_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = F.when(F.col("o_orderstatus") == "O", "Btn").when(F.col("o_orderstatus") == "F", "Ch").otherwise("Tx")
    flags = ((F.col("o_custkey") * 4099 + F.col("o_orderkey") * 65537) % 33554432).alias("flags")
    f = table(spark, sf_dir, "orders").select("o_orderkey", ft.alias("ft"), flags)
    bit = lambda n: F.col("flags").bitwiseAND(F.lit(n)) != 0
    return f.select(
        "o_orderkey", T.field_kind(F.col("ft"), F.col("flags")).alias("kind"), bit(1).alias("readonly"), bit(2).alias("required"), bit(4096).alias("multiline"),
        F.when(bit(8192), "[redacted]").otherwise(F.col("flags").cast("string")).alias("value"),
    )


@query("F-60", "SELECT l_orderkey, l_linenumber, l_partkey, round(1 - least(1, l_discount * 5 + l_tax), 9) AS r, round(1 - least(1, l_tax * 3 + l_tax), 9) AS g, round(greatest(abs(l_discount * 5 - l_tax * 3), 0), 9) AS distance FROM lineitem")
def colour_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, k = F.col("l_discount") * 5, F.col("l_tax") * 3, F.col("l_tax")
    rgb = T.cmyk_to_rgb(c, m, F.lit(0.0), k)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(rgb["r"], 9).alias("r"), F.round(rgb["g"], 9).alias("g"), F.round(F.abs(c - m), 9).alias("distance"))


@query(
    "F-10 D-51",
    """SELECT n_nationkey, n_name AS title, CASE WHEN n_nationkey % 4 = 0 THEN 'xiv' ELSE cast(n_nationkey * 3 AS varchar) END AS page_label, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE cast(n_nationkey * 3 AS INT) END AS page FROM nation""",
)
def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    line = F.concat(F.col("n_name"), F.lit(" "), F.repeat(F.lit("."), (2 + k % 5).cast("int")), F.lit(" "), F.when(k % 4 == 0, "xiv").otherwise((k * 3).cast("string")))
    entry = T.contents_entry(line)
    return table(spark, sf_dir, "nation").select("n_nationkey", entry["title"].alias("title"), entry["page"].alias("page_label"), entry["page"].try_cast("int").alias("page"))


_BARE = "list_transform(list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), lambda w: lower(trim(w, '()[]{}.,;:\"''“”‘’!?')))"
_WORDS = "list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


@query(
    "F-09 F-08 D-50",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    w AS (SELECT doc_id, i, line, {_WORDS} AS words, {_BARE} AS bare FROM l),
    p AS (SELECT doc_id, i, words,
      CASE WHEN list_has_any(bare, ['doi', 'isbn', 'issn', 'arxiv', 'urn', 'pmid']) OR len(list_filter(words, lambda w: starts_with(lower(w), 'http://') OR starts_with(lower(w), 'https://') OR starts_with(lower(w), 'www.'))) > 0 THEN 2 ELSE 0 END
      + CASE WHEN list_has_any(bare, ['press', 'verlag', 'journal', 'proceedings', 'proc', 'conference', 'transactions', 'thesis', 'dissertation', 'university', 'publisher', 'ed', 'eds', 'vol', 'volume', 'pp', 'issue']) THEN 2 ELSE 0 END
      + CASE WHEN len(list_filter(range(1, len(words)), lambda k: ends_with(words[k], ',') AND regexp_full_match(words[k + 1], '[A-Z][.]'))) > 0 THEN 1 ELSE 0 END
      + CASE WHEN len(list_filter(bare, lambda w: regexp_full_match(w, '[0-9]{{4}}') AND try_cast(w AS INT) BETWEEN 1500 AND 2099)) > 0 THEN 1 ELSE 0 END
      + CASE WHEN length(line) - length(translate(line, '.,;:', '')) > 2 THEN 1 ELSE 0 END AS points FROM w)
    SELECT doc_id, i, length(list_aggregate(words, 'string_agg', ' ')) >= 8 AND points >= 2 AS citation FROM p""",
)
def citation_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", "i", cites_column(F.col("line")).alias("citation"))
