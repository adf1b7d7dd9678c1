"""The queries of the corpus operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .decontaminate import contaminated_documents
from .exact_dedup import exact_groups
from .filter_audit import audit_filters
from .fingerprints import compare_with_next
from .html_extract import extract_pages
from .language_id import fit_network, identify_languages
from .minhash_dedup import near_duplicates
from .packing import pack_documents
from .substring_dedup import substring_dedup
from .toxicity import fit_lexicon, score_toxicity
from .warc import archive_pages
from .whitening import whitened_components


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup(_read(spark, sf_dir, "documents"))
    return cleaned.selectExpr("doc_id", "text", "n_removed", "to_json(removed_spans) as removed_spans")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_read(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_lexicon(docs, _read(spark, sf_dir, "labels")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return identify_languages(docs, fit_network(docs))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path or default_tokenizer(), digests=True)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(_read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_substring_dedup,
        op3_minhash_dedup,
        op4_warc,
        op5_toxicity,
        op6_best_fit_packing,
        op7_language_id,
        op8_fingerprints,
        op9_html_extraction,
        op10_bpe,
        op11_embedding_whitening,
        op12_filter_audit,
        op13_decontamination,
    )
}

_SPACE = r"[\t-\r ]+"

ORACLE_SQL = {
    "op1_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op2_substring_dedup": r"""
        WITH units AS (
            SELECT doc_id, u.unnest AS unit, u.ordinality - 1 AS pos
            FROM documents, unnest(regexp_extract_all(text, '[^\n]*?(?:[.!?,;:][!-/:-@\[-^`{-~]{0,8}[ \t]|\n|\z)')) WITH ORDINALITY AS u
            WHERE u.unnest <> ''),
        measured AS (
            SELECT *, len(regexp_extract_all(unit, '[^\x20\t-\r]+')) AS n, sum(length(unit)) OVER w - length(unit) AS a, sum(length(unit)) OVER w AS b
            FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        counted AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS before FROM measured),
        paragraphs AS (
            SELECT x.doc_id, x.pos, y.pos AS last, x.a, y.b
            FROM counted x JOIN counted y ON y.doc_id = x.doc_id AND y.before < x.before + 20 AND y.before + y.n >= x.before + 20
            WHERE x.n > 0),
        named AS (
            SELECT p.*, md5(trim(regexp_replace(lower(substring(d.text, (a + 1)::BIGINT, (b - a)::BIGINT)), '[\x20\t-\r]+', ' ', 'g'))) AS digest
            FROM paragraphs p JOIN documents d USING (doc_id)),
        ranked AS (
            SELECT *, first_value(doc_id) OVER w AS f_doc, first_value(pos) OVER w AS f_pos, first_value(last) OVER w AS f_last
            FROM named WINDOW w AS (PARTITION BY digest ORDER BY doc_id, pos)),
        own AS (SELECT *, first_value(last) OVER (PARTITION BY digest, doc_id ORDER BY pos) AS o_last FROM ranked),
        removed AS (
            SELECT *, coalesce(pos - lag(pos) OVER w > 1, true) OR coalesce(lead(pos) OVER w - pos > 1, true) AS edge
            FROM own WHERE doc_id <> f_doc OR pos > o_last WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        tokens AS (
            SELECT doc_id, ordinality AS k, ltrim(unnest, E' \t\n\r\x0b\f') AS word, sum(length(unnest)) OVER (PARTITION BY doc_id ORDER BY ordinality) AS e
            FROM documents, unnest(regexp_extract_all(text, '[\x20\t-\r]*[^\x20\t-\r]+')) WITH ORDINALITY),
        words AS (SELECT doc_id, list(lower(word) ORDER BY k) AS w, list(e - length(word) ORDER BY k) AS s, list(e ORDER BY k) AS e FROM tokens GROUP BY doc_id),
        asked AS (
            SELECT r.doc_id, r.pos, d.before AS i, e.before + e.n AS j, r.f_doc, r.f_pos, r.f_last, f.before AS fi, g.before + g.n AS fj
            FROM removed r JOIN counted d USING (doc_id, pos) JOIN counted e ON e.doc_id = r.doc_id AND e.pos = r.last
                 JOIN counted f ON f.doc_id = r.f_doc AND f.pos = r.f_pos JOIN counted g ON g.doc_id = r.f_doc AND g.pos = r.f_last
            WHERE edge AND r.doc_id <> r.f_doc),
        places AS (SELECT DISTINCT f_doc, f_pos, f_last, fj FROM asked),
        lefts AS (SELECT f_doc, f_pos, arg_max(n, u.pos) AS reach FROM places JOIN counted u ON u.doc_id = f_doc AND u.pos < f_pos AND n > 0 GROUP BY ALL),
        behind AS (SELECT f_doc, f_pos, u.before + u.n - fj AS c FROM places JOIN counted u ON u.doc_id = f_doc AND u.pos > f_last),
        rights AS (
            SELECT f_doc, f_pos, coalesce(min(c) FILTER (c > enough), max(c)) AS reach
            FROM behind JOIN (SELECT f_doc, f_pos, min(c) FILTER (c >= 20) AS enough FROM behind GROUP BY ALL) USING (f_doc, f_pos) GROUP BY ALL),
        grown AS (
            SELECT x.doc_id, x.pos, d.s, d.e, i, j,
                   list_transform(range(1, (least(coalesce(l.reach, 0), i) + 1)::BIGINT), lambda t: d.w[(i - t + 1)::BIGINT] = f.w[(fi - t + 1)::BIGINT]) AS before,
                   list_transform(range(1, (least(coalesce(r.reach, 0), len(d.w) - j) + 1)::BIGINT), lambda t: d.w[(j + t)::BIGINT] = f.w[(fj + t)::BIGINT]) AS after
            FROM asked x JOIN words d USING (doc_id) JOIN words f ON f.doc_id = f_doc LEFT JOIN lefts l USING (f_doc, f_pos) LEFT JOIN rights r USING (f_doc, f_pos)),
        sides AS (
            SELECT doc_id, pos, s[(i - coalesce(nullif(list_position(before, false), 0) - 1, len(before)) + 1)::BIGINT] AS a, e[(j + coalesce(nullif(list_position(after, false), 0) - 1, len(after)))::BIGINT] AS b
            FROM grown),
        whole AS (SELECT r.doc_id, least(r.a, coalesce(x.a, r.a)) AS a, greatest(r.b, coalesce(x.b, r.b)) AS b FROM removed r LEFT JOIN sides x USING (doc_id, pos)),
        edges AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS apart FROM whole),
        spans AS (
            SELECT doc_id, min(a) AS a, max(b) AS b
            FROM (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM edges) GROUP BY doc_id, k),
        gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
        gone AS (
            SELECT doc_id, count(*)::INT AS n, '[' || string_agg('{"start":' || a::BIGINT || ',"end":' || b::BIGINT || '}', ',' ORDER BY a) || ']' AS removed,
                   string_agg(substring(d.text, (since + 1)::BIGINT, (a - since)::BIGINT), '' ORDER BY a) || substring(any_value(d.text), (max(b) + 1)::BIGINT) AS text
            FROM gaps JOIN documents d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(g.text, d.text) AS text, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '[]') AS removed_spans
        FROM documents d LEFT JOIN gone g USING (doc_id)""",
    "op4_warc": """
        WITH p AS (
            SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to, url
        FROM f""",
    "op12_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\t-\r]+') AS w FROM documents),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        fails AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                   + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false)::INT AS mask
            FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
        sizes AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (
            SELECT filter_order, s.step, bits[s.step] AS bit, coalesce(list_sum(bits[:s.step - 1]), 0)::INT AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
        counted AS (
            SELECT part, filter_order, step, bit,
                   sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept,
                   sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS removed,
                   sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0) AS redundant,
                   sum(n) FILTER (WHERE mask = bit) AS unique_fails,
                   sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS good_lost,
                   sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS toxic_lost
            FROM steps, sizes GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
               coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM counted""",
    "op13_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE item_id IS NOT NULL),
        phrases AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
        hits AS (
            SELECT doc_id, k, p.m, item_id
            FROM (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS phrase FROM places, (SELECT DISTINCT m FROM phrases) WHERE k + m - 1 <= len(w)) x
            JOIN phrases p ON p.phrase = x.phrase AND p.m = x.m),
        covered AS (SELECT doc_id, count(DISTINCT k + o) AS n FROM (SELECT doc_id, k, unnest(range(0, m)) AS o FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
               sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)""",
}
