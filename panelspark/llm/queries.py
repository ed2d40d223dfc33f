"""One query per operator over the given tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.collocations import collocations
from panelspark.llm.decontaminate import find_items
from panelspark.llm.exact_dedup import exact_dedup
from panelspark.llm.html_main import main_text
from panelspark.llm.line_dedup import line_dedup
from panelspark.llm.mixing import mix_plan
from panelspark.llm.ngram_jaccard import ngram_jaccard_components
from panelspark.llm.repeats import repeated_passages
from panelspark.llm.simhash import fingerprint_hex, simhash_components
from panelspark.llm.spelling import MIN_COUNT, count_runs, spelling_variants
from panelspark.llm.token_counts import count_tokens
from panelspark.llm.token_files import token_files
from panelspark.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Space, tab, line feed, vertical tab, form feed and carriage return, as SQL.
SQL_WHITE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_main")
def op1_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


@query("op4_repeats")
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ITEM_WORDS = f"regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op6_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
    b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {ITEM_WORDS} AS w FROM benchmark),
    win AS (
        SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS t
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
    ), places AS (
        SELECT doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') AS t
        FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS p FROM d, (SELECT DISTINCT l FROM win))
    ), hits AS (SELECT DISTINCT doc_id, p, l, item FROM places JOIN win USING (t, l)),
    covered AS (SELECT doc_id, count(DISTINCT c) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + l - 1)) AS c FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named i USING (doc_id)
    """,
)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query(
    "op8_line_dedup",
    f"""
    WITH lines AS (
        SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    ), keyed AS (
        SELECT doc_id, pos, line, {ASCII_LOWER.format(f"trim(line, {SQL_WHITE})")} AS k FROM lines
    ), firsts AS (
        SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
    ), marked AS (
        SELECT doc_id, pos, line, coalesce(doc_id > first_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "full", "shard", "taken")


@query(
    "op10_exact_dedup",
    f"""
    WITH normal AS (SELECT doc_id, {ASCII_LOWER.format("coalesce(text, '')")} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM normal
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query(
    "op11_collocations",
    f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
    ), worded AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    tokens AS (SELECT lang, p, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded WHERE len(w) > 0),
    f1 AS (SELECT lang, word, count(*) AS a FROM tokens GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang),
    g1 AS (SELECT lang, p, i, word FROM tokens JOIN f1 USING (lang, word) WHERE a >= 30),
    g2 AS (SELECT x.lang, x.p, x.i, x.word || ' ' || y.word AS phrase FROM g1 x JOIN g1 y ON y.p = x.p AND y.i = x.i + 1),
    g3 AS (SELECT x.lang, x.p, x.i, x.phrase || ' ' || y.word AS phrase FROM g2 x JOIN g1 y ON y.p = x.p AND y.i = x.i + 2),
    g4 AS (SELECT x.lang, x.p, x.i, x.phrase || ' ' || y.word AS phrase FROM g3 x JOIN g1 y ON y.p = x.p AND y.i = x.i + 3),
    f AS (
        SELECT lang, 1 AS k, word AS phrase, a FROM f1 UNION ALL SELECT lang, 2, phrase, count(*) FROM g2 GROUP BY ALL
        UNION ALL SELECT lang, 3, phrase, count(*) FROM g3 GROUP BY ALL UNION ALL SELECT lang, 4, phrase, count(*) FROM g4 GROUP BY ALL
    ), frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE a >= 30),
    cuts AS (
        SELECT lang, phrase, w, k, a, c FROM frequent, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k
    ), scored AS (
        SELECT x.lang, x.phrase, x.k, x.a, c, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * x.a) // (CAST(l.a AS HUGEINT) + r.a) AS score
        FROM cuts x JOIN frequent l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : c], ' ')
        JOIN frequent r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[c + 1 : x.k], ' ')
    ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    inner_of AS (
        SELECT x.lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS longer
        FROM frequent x, (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([2, 3]) AS m) WHERE m < k AND s + m - 1 <= k GROUP BY ALL
    ), kept AS (
        SELECT t.* FROM lowest t LEFT JOIN inner_of i ON i.lang = t.lang AND i.phrase = t.phrase
        WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: One in so many distinct words of a document loses a letter.
DAMAGE = 31


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_runs(table(spark, sf_dir, "documents"), damage_every=DAMAGE)
    return spelling_variants(words.where(F.col("n") >= MIN_COUNT))


@query(
    "op13_ngram_jaccard",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)
    ), reach AS (
        SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
    ), smallest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN smallest USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
)
def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))
