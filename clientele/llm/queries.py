"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.chosen_path import chosen_path_duplicates
from clientele.llm.exact_dedup import exact_groups
from clientele.llm.html_text import main_text
from clientele.llm.language_model import score_documents
from clientele.llm.lexical import ranked_search
from clientele.llm.licenses import (
    CUE,
    LEAST_COSINE,
    LEAST_SHARE,
    TEMPLATES,
    document_path,
    scan_licenses,
    template_table,
)
from clientele.llm.mixing import mix_schedule
from clientele.llm.packing import pack_documents
from clientele.llm.runs import run_digests
from clientele.llm.shingle_join import near_duplicates
from clientele.llm.topk import exact_top_k
from clientele.llm.toxicity import toxicity
from clientele.llm.url_cascade import judge_urls, rule_table


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return toxicity(docs, _table(spark, folder, "labels").select("doc_id", "toxic"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(_table(spark, folder, "documents"))


def op9_url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    rules, lengths = rule_table(spark)
    return judge_urls(pages, rules, lengths).select("page_id", "host", "path", "rule", "verdict")


def op10_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    files = docs.select(document_path().alias("path"), "text")
    found = scan_licenses(files, template_table(spark))
    name = F.regexp_extract("path", r"([^/]*)\.txt$", 1)
    return found.withColumn("doc_id", F.when(name != "", name).cast("bigint"))


def op4_max_entropy_lm(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(_table(spark, folder, "documents").select("doc_id", "text"))


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = main_text(_table(spark, folder, "pages"))
    size = F.char_length("text").cast("long").alias("n_chars")
    return texts.select("page_id", "url", "text", size)


def tokenizer_path() -> str:
    """Where this machine has the vocabulary file that documents are packed with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path)


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    return mix_schedule(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_chosen_path_join(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return ranked_search(docs, _table(spark, folder, "benchmark").select("item_id", "text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_digests(_table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_max_entropy_lm": op4_max_entropy_lm,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_html_text": op6_html_text,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_source_mix": op8_source_mix,
    "op9_url_cascade": op9_url_cascade,
    "op10_shingle_join": op10_shingle_join,
    "op11_chosen_path_join": op11_chosen_path_join,
    "op12_ranked_search": op12_ranked_search,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# Runs of ASCII letters and digits and of characters beyond ASCII.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _linked_classes(words: int, percent: int) -> str:
    """SQL for the size of each document's shingle set and the smallest id linked with it.

    The different sets stand for their documents; links between them are followed to the end.
    """
    shingle = "list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i:i + {0} - 1], ' '))"
    return rf"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {words}
                THEN {shingle.format(words)} WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
                ELSE [] END)) AS s FROM words),
        classes AS MATERIALIZED (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
        entries AS MATERIALIZED (SELECT rep, n, unnest(s) AS shingle FROM classes),
        links AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b
            FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.rep <> b.rep
                AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
            GROUP BY a.rep, b.rep, a.n, b.n
            HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        reached(node, low) USING KEY (node) AS (SELECT rep, rep FROM classes
            UNION (SELECT b AS node, min(reached.low) AS low FROM reached JOIN links ON a = node
                JOIN recurring.reached AS known ON known.node = b WHERE reached.low < known.low GROUP BY b)),
        found AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id
            FROM sets LEFT JOIN classes USING (s) LEFT JOIN reached ON rep = node)
    """


ORACLE = {
    "op10_shingle_join": f"{_linked_classes(5, 75)} SELECT * FROM found",
    "op11_chosen_path_join": f"""{_linked_classes(2, 80)}
        SELECT *, doc_id = component_id AS kept FROM found""",
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWERED} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op3_license_scan": rf"""
        WITH templates(license, line) AS (VALUES {", ".join(f"('{n}', '{t}')" for n, t in TEMPLATES)}),
        files AS (SELECT doc_id, coalesce(text, '') AS text,
                coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/'
                || regexp_replace(doc_id::VARCHAR, '(.)', '\1/', 'g') || doc_id || '.txt' AS path
            FROM documents),
        cued AS (SELECT path, text, list_filter(string_split_regex(text, '[\r\n]+'),
                lambda x: regexp_matches(x, '{CUE}')) AS lines
            FROM files WHERE regexp_matches(text, '{CUE}')),
        headers AS (SELECT path, trim(regexp_replace(unnest(lines), '\s+', ' ', 'g')) AS line,
                len(list_filter(string_split_regex(array_to_string(lines, ' '), '\s+'), lambda w: w <> ''))
                / greatest(1, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')))
                >= {LEAST_SHARE} AS is_file
            FROM cued),
        units AS (SELECT 0 AS kind, line AS unit, line FROM (SELECT DISTINCT line FROM headers)
            UNION ALL SELECT 1, license, line FROM templates),
        counts AS (SELECT kind, unit, term, count(*) AS tf FROM (SELECT kind, unit,
                unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM units) GROUP BY ALL),
        idf AS (SELECT term, ln((1 + (SELECT count(*) FROM units)) / (1 + count(*))) + 1 AS idf
            FROM counts GROUP BY term),
        weights AS (SELECT kind, unit, term, tf * idf AS w,
                sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY kind, unit)) AS size
            FROM counts JOIN idf USING (term)),
        matched AS (SELECT a.unit AS line, b.unit AS license, round(sum(a.w / a.size * b.w / b.size), 6) AS cosine
            FROM weights a JOIN weights b ON a.kind = 0 AND b.kind = 1 AND a.term = b.term GROUP BY ALL),
        own AS (SELECT path, license, cosine, is_file FROM headers JOIN matched USING (line)
            WHERE cosine >= {LEAST_COSINE}
            QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) = 1),
        directories AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, license AS inherited
            FROM own WHERE is_file
            QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, license) = 1),
        nearest AS (SELECT path, inherited, directory
            FROM files JOIN directories ON starts_with(path, directory || '/')
            WHERE path NOT IN (SELECT path FROM own)
            QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(directory) DESC) = 1)
        SELECT doc_id, path, license AS own_license, cosine AS own_cosine,
            coalesce(license, inherited) AS license, directory AS license_directory,
            CASE WHEN license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END
                WHEN inherited IS NOT NULL THEN 'directory' END AS origin
        FROM files LEFT JOIN own USING (path) LEFT JOIN nearest USING (path)
    """,
    "op5_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
            FROM embeddings WHERE embedding IS NOT NULL
            AND list_count(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM s) WHERE rank <= 5
    """,
    "op12_ranked_search": rf"""
        WITH words AS (SELECT rowid_ AS doc, doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS w
            FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
        sizes AS (SELECT doc, doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
        whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term
            FROM benchmark),
        held AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(w) AS term FROM words)
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM held, whole GROUP BY term, n_docs),
        worth AS (SELECT doc, term, w * ((1000000000 * tf)
                // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS worth
            FROM held JOIN sizes USING (doc) JOIN weights USING (term), whole),
        scores AS (SELECT item_id, doc, sum(worth)::BIGINT AS score FROM asked JOIN worth USING (term)
            GROUP BY ALL HAVING sum(worth) > 0),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id
                ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
            FROM scores JOIN sizes USING (doc))
        SELECT * FROM ranked WHERE rank <= 50
    """,
    "op9_url_cascade": r"""
        WITH rules(verdict, rhost, rpath) AS (VALUES
            ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
            ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
            ('block', 'com', '/de/')),
        p AS (SELECT page_id,
            translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        fits AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict,
            row_number() OVER (PARTITION BY page_id
                ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
            FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost))
                AND starts_with(path, rpath))
        SELECT p.page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM p LEFT JOIN fits ON fits.page_id = p.page_id AND place = 1
    """,
}
