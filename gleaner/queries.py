"""Named queries over the tables of a folder, each with its SQL for another engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import values as V
from .functions import money as M
from .functions import text as T
from .operators import catalog, discovery, feedback, matching, ranking, resolve, rules, state
from .sources.postings import STAR_SQL, from_star_schema, source_counts
from .streaming import jobs
from .tables import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

c = F.col
P = from_star_schema


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def with_p(sql: str) -> str:
    return f"WITH {STAR_SQL} {sql}"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_day = lambda x: F.date_format(x, "yyyy-MM-dd")

# ---------------------------------------------------------------- scans and projections


@query(with_p("SELECT * EXCLUDE (posted), strftime(posted, '%Y-%m-%d') AS posted FROM p"))
def postings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P(spark, sf_dir).withColumn("posted", _day("posted"))


@query(with_p("SELECT source, count(*) AS postings FROM p GROUP BY source"))
def posting_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_counts(P(spark, sf_dir))


_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9à-ÿß+#]+')"
_COMPANY = f"list_filter({_WORDS.format('company')}, lambda w: NOT list_contains({_sql_list(V.LEGAL)}, w))"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_RAW_KEY = f"{_NORM.format('company')} || '|' || " + _NORM.format(r"split_part(regexp_replace(title, '(?i)\s*\((m|f|w|d|x|h)(/(m|f|w|d|x|h))+\)', '', 'g'), ' | ', 1)")
# the adapter's titles hold gender tags in parentheses and parts behind dashes
_CANON_SQL = f"""
    t1 AS (SELECT seq, regexp_replace(title, '(?i){V.GENDER_TAG}', ' ', 'g') AS t FROM p),
    t2 AS (SELECT seq, t, list_filter(regexp_split_to_array(t, '\\s+[-–—|/]\\s+|\\s*\\|\\s*|,\\s+'),
                  lambda x: len(list_filter({_WORDS.format('x')}, lambda w: NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_sql_list(V.TITLE_NOISE)}, w))) > 0) AS parts FROM t1),
    canon AS (SELECT seq, array_to_string(regexp_extract_all(lower(CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ') ELSE t END), '[a-z0-9à-ÿß+#]+'), ' ') AS canon FROM t2)"""


@query(
    with_p(f""", {_CANON_SQL}, w AS (SELECT seq, {_COMPANY} AS cw, {_RAW_KEY} AS raw_key,
        trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '(?i){V.GENDER_TAG_VERDICT}', ' ', 'g')), '\\s+', ' ', 'g'), '^[ ,|·–-]+|[ ,|·–-]+$', '', 'g')) AS title_norm FROM p)
    SELECT w.seq, raw_key, title_norm, array_to_string(cw, ' ') AS company_words,
           CASE WHEN len(cw) > 1 AND cw[-1] = 'labs' THEN array_to_string(cw[:-2], '') ELSE array_to_string(cw, '') END AS company_key, canon
    FROM w JOIN canon USING (seq)""")
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P(spark, sf_dir).select(
        "seq",
        T.raw_key(c("company"), c("title")).alias("raw_key"),
        T.title_norm(c("title")).alias("title_norm"),
        F.array_join(T.company_tokens(c("company")), " ").alias("company_words"),
        T.company_key(c("company")).alias("company_key"),
        T.title_canon(c("title")).alias("canon"),
    )


_SIGNATURE_SQL = """CASE WHEN length(array_to_string(w, ' ')) >= 300 THEN
        list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: md5(array_to_string(w[i:i + 4], ' ')))))[1:64] ELSE [] END"""


@query(f"""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9à-ÿß+#]+')[1:800] AS w FROM documents),
    s AS (SELECT doc_id, {_SIGNATURE_SQL} AS s FROM t)
    SELECT doc_id, len(s)::INT AS n, array_to_string(s, ',') AS signature FROM s""")
def shingle_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", T.signature(c("text"), F.md5).alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.array_join("s", ",").alias("signature"))


_COUNTS = ", ".join(f"len(list_filter(w, lambda x: list_contains({_sql_list(ws)}, x))) AS n_{name}" for name, ws in V.LANGUAGE_WORDS.items())
_WRITTEN_SQL = f"""
    t AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-zäöüßàâçéèêëîïôûùñáíóú]+')[1:600] AS w FROM documents),
    n AS (SELECT doc_id, lang, len(w) AS total, {_COUNTS} FROM t),
    b AS (SELECT *, greatest({', '.join(f'n_{x}' for x in V.LANGUAGE_WORDS)}) AS best FROM n),
    wr AS (SELECT doc_id, lang, CASE WHEN best < 12 OR best < 0.08 * total THEN '' {' '.join(f"WHEN n_{x} = best THEN '{x}'" for x in V.LANGUAGE_WORDS)} END AS written_in FROM b)"""


@query(f"WITH {_WRITTEN_SQL} SELECT doc_id, written_in FROM wr")
def written_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.written_in(c("text")).alias("written_in"))


@query(f"WITH {_WRITTEN_SQL} SELECT lang, written_in, count(*) AS n FROM wr GROUP BY ALL")
def written_in_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("lang", T.written_in(c("text")).alias("written_in"))
    return d.groupBy("lang", "written_in").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<(br|/p|/li|/h\d)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
           '[ \t' || chr(160) || ']+', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM pages""")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags only; references stay, as the other engine can't decode them."""
    return _read(spark, sf_dir, "pages").select("page_id", T.strip_html(c("html"), lambda x: x).alias("text"))


@query(r"""
    WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)href=["'']([^"''#]+)', 1) AS l FROM pages)
    SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS link FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.posexplode(discovery.links(c("html"))).alias("pos", "link"))


@query(r"""
    SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
           regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.coalesce(F.parse_url("url", F.lit(n)), F.lit("")).alias({"PROTOCOL": "scheme"}.get(n, n.lower()))
    return _read(spark, sf_dir, "pages").select("page_id", part("PROTOCOL"), part("HOST"), part("PATH"))


# ---------------------------------------------------------------- filters

_FX = "CASE upper(coalesce(nullif(currency, ''), 'EUR')) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.FX.items()) + " ELSE 1.0 END"
_TOP = f"coalesce(nullif(salary_max, 0), salary_min) * CAST({_FX} AS DOUBLE)"
PROFILE = rules.Profile(
    title_include=(r"\b(ring|bolt|gear)\b",),
    title_exclude=(r"\bjunior\b",),
    blocked_titles=("red bolt",),
    blocked_companies=("supplier#000000003",),
    home=("AFRICA",),
    remote_ok=("EUROPE", "ASIA"),
    floor=35_500,
    hard_exclude=(r"\bloser\b", r"\bscum\b"),
    require_written_in=("english", "german"),
)
NOW = "2024-02-20"


@query(with_p(f"SELECT seq, round({_TOP}, 6) AS eur, coalesce({_TOP} >= 1000 AND {_TOP} < 35500, false) AS below_floor FROM p"))
def salary_eur_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P(spark, sf_dir)
    low = rules.below_floor(PROFILE, c("salary_min"), c("salary_max"), c("currency"))
    return p.select("seq", F.round(M.top_salary(c("salary_min"), c("salary_max"), c("currency")), 6).alias("eur"), low.alias("below_floor"))


_LOC_SQL = """CASE WHEN regexp_matches(location, '(?i)\\bAFRICA\\b') THEN 'local'
    WHEN (remote OR regexp_matches(location, '(?i)\\b(remote|remoto|anywhere|distributed|home ?office|home[- ]based|work from home|fully remote)\\b'))
         AND regexp_matches(location, '(?i)\\b(EUROPE|ASIA)\\b') THEN 'remote' ELSE '' END"""


@query(with_p(f"SELECT seq, {_LOC_SQL} AS loc_class FROM p"))
def location_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P(spark, sf_dir).select("seq", rules.location_class(PROFILE, c("location"), c("text"), c("remote")).alias("loc_class"))


@query(
    with_p(f""", {_WRITTEN_SQL},
    f AS (SELECT seq, {_COMPANY} AS cw, {_LOC_SQL} AS loc, p.*,
        trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '(?i){V.GENDER_TAG_VERDICT}', ' ', 'g')), '\\s+', ' ', 'g'), '^[ ,|·–-]+|[ ,|·–-]+$', '', 'g')) AS tn
        FROM p)
    SELECT f.seq, CASE
        WHEN (CASE WHEN len(cw) > 1 AND cw[-1] = 'labs' THEN array_to_string(cw[:-2], '') ELSE array_to_string(cw, '') END) = 'supplier#000000003' THEN 'company'
        WHEN tn = 'red bolt' OR regexp_matches(title, '(?i)\\bjunior\\b') OR NOT regexp_matches(title, '(?i)\\b(ring|bolt|gear)\\b') THEN 'title'
        WHEN loc = '' AND NOT regexp_matches(employment_type, '(?i)\\b(freelance|temporary)\\b') THEN 'location'
        WHEN NOT direct AND posted < TIMESTAMP '{NOW}' - INTERVAL 45 DAY THEN 'too old'
        WHEN {_TOP} >= 1000 AND {_TOP} < 35500 THEN 'stated salary below floor'
        WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])loser($|[^\\p{{L}}\\p{{N}}_])') THEN 'excluded: “' || regexp_extract(text, '(?i)loser') || '”'
        WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])scum($|[^\\p{{L}}\\p{{N}}_])') THEN 'excluded: “' || regexp_extract(text, '(?i)scum') || '”'
        WHEN written_in NOT IN ('english', 'german') THEN 'requirement not met' ELSE '' END AS reason
    FROM f JOIN wr ON wr.doc_id = f.seq""")
)
def prefilter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P(spark, sf_dir).select("seq", rules.prefilter(PROFILE, F.lit(NOW).cast("timestamp")).alias("reason"))


@query(with_p("SELECT seq FROM p WHERE posted IS NULL OR posted >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY OR direct"))
def fresh_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.coalesce(c("posted") < F.lit("2024-02-01").cast("timestamp") - F.make_dt_interval(F.lit(30)), F.lit(False))
    return P(spark, sf_dir).where(~(old & ~c("direct"))).select("seq")


# ---------------------------------------------------------------- entity resolution

_BEST_SQL = """
    best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY direct DESC, partner = '' DESC, length(text) DESC, coalesce(salary_max, 0) <> 0 DESC, seq) AS r,
             count(*) OVER (PARTITION BY k) AS copies, bool_or(remote) OVER (PARTITION BY k) AS any_remote,
             min(seq) OVER (PARTITION BY k) AS cluster_id FROM keyed),
    pay AS (SELECT DISTINCT ON (k) k, salary_min AS p_min, salary_max AS p_max, currency AS p_cur FROM keyed WHERE coalesce(salary_max, 0) <> 0 ORDER BY k, seq),
    kind AS (SELECT DISTINCT ON (k) k, employment_type AS p_type FROM keyed WHERE employment_type <> '' ORDER BY k, seq),
    dated AS (SELECT DISTINCT ON (k) k, posted AS p_posted FROM keyed WHERE posted IS NOT NULL ORDER BY k, seq)
    SELECT cluster_id, seq, copies::INT AS copies, source, any_remote AS remote, coalesce(nullif(employment_type, ''), p_type, '') AS employment_type,
           strftime(coalesce(posted, p_posted), '%Y-%m-%d') AS posted, CASE WHEN coalesce(salary_max, 0) = 0 AND p_max IS NOT NULL THEN p_max ELSE salary_max END AS salary_max,
           CASE WHEN coalesce(salary_max, 0) = 0 AND p_max IS NOT NULL THEN p_cur ELSE currency END AS currency
    FROM best LEFT JOIN pay USING (k) LEFT JOIN kind USING (k) LEFT JOIN dated USING (k) WHERE r = 1"""


def _best(clustered: DataFrame) -> DataFrame:
    best = resolve.best_of_clusters(clustered)
    return best.select("cluster_id", "seq", "copies", "source", "remote", "employment_type", _day("posted").alias("posted"), "salary_max", "currency")


@query(with_p(f", keyed AS (SELECT *, {_RAW_KEY} AS k FROM p), {_BEST_SQL}"))
def raw_key_dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P(spark, sf_dir).withColumn("k", T.raw_key(c("company"), c("title")))
    ids = p.groupBy("k").agg(F.min("seq").alias("cluster_id"))
    return _best(p.join(ids, "k"))


@query(with_p(f", {_CANON_SQL}, w AS (SELECT p.*, array_to_string({_COMPANY}, '') || '|' || canon AS k FROM p JOIN canon USING (seq)), keyed AS (SELECT * FROM w), {_BEST_SQL}"))
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(resolve.clusters_by_closure(P(spark, sf_dir), exact_only=True))


_KEYED_SQL = f"""{_CANON_SQL},
    kw AS (SELECT p.seq, p.source, title, length(text) AS chars, {_COMPANY} AS cw, canon, regexp_extract_all(lower(text), '[a-z0-9à-ÿß+#]+')[1:800] AS w FROM p JOIN canon USING (seq)),
    ks AS (SELECT seq, source, title, chars, cw, array_to_string(cw, '') AS co, canon, {_SIGNATURE_SQL} AS s FROM kw)"""
_SIM = """CASE WHEN len(a.s) > 0 AND len(b.s) > 0 THEN len(list_intersect(list_intersect(list_sort(list_distinct(list_concat(a.s, b.s)))[1:64], a.s), b.s))
    / least(64, len(list_distinct(list_concat(a.s, b.s)))) END"""
_LONG = " responsible for the growth of all plants in the northern region and their partners"


def with_reposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings and what other sources make of some: a longer title, a title cut at 75 characters, a longer company name. A repost
    has the text of its posting, so the signature of both is made once."""
    p = P(spark, sf_dir).withColumn("signature", T.md5_numbers(c("text")))
    long = F.concat("title", F.lit(_LONG))

    def repost(k: int, source: Column, every: int, title: Column = c("title"), company: Column = c("company")) -> Column:
        return F.when(c("seq") % every == 0, F.struct((c("seq") + k * 10_000_000_000).alias("seq"), source.alias("source"), company.alias("company"), title.alias("title")))

    shown = F.array(
        repost(0, c("source"), 1),
        repost(1, F.lit("mirror-a"), 5, title=F.concat("title", F.lit(" Team"))),
        repost(2, F.lit("long-a"), 7, title=long),
        repost(3, F.lit("long-b"), 7, title=F.left(long, F.lit(75))),
        repost(4, F.lit("mirror-c"), 9, company=F.concat("company", F.lit(" Marine"))),
    )
    rows = p.withColumn("shown", F.explode(F.array_compact(shown)))
    return rows.select(*[f"shown.{n}" if n in ("seq", "source", "company", "title") else n for n in p.columns])


_REPOSTS_SQL = STAR_SQL.replace("p AS (", "p0 AS (", 1) + f""", p AS (SELECT * FROM p0
    UNION ALL SELECT * REPLACE (seq + 10000000000 AS seq, 'mirror-a' AS source, title || ' Team' AS title) FROM p0 WHERE seq % 5 = 0
    UNION ALL SELECT * REPLACE (seq + 20000000000 AS seq, 'long-a' AS source, title || '{_LONG}' AS title) FROM p0 WHERE seq % 7 = 0
    UNION ALL SELECT * REPLACE (seq + 30000000000 AS seq, 'long-b' AS source, (title || '{_LONG}')[1:75] AS title) FROM p0 WHERE seq % 7 = 0
    UNION ALL SELECT * REPLACE (seq + 40000000000 AS seq, 'mirror-c' AS source, company || ' Marine' AS company) FROM p0 WHERE seq % 9 = 0)"""
_HEADS_SQL = "heads AS (SELECT DISTINCT ON (co, canon, source) * FROM ks ORDER BY co, canon, source, chars DESC, seq)"
_COMPANY_PAIRS_SQL = f"""
    cp AS (SELECT a.seq AS a, b.seq AS b, {_SIM} AS sim, a.canon AS ta, b.canon AS tb, length(trim(a.title)) AS na, length(trim(b.title)) AS nb
           FROM heads a JOIN heads b ON a.co = b.co AND a.seq < b.seq AND a.source <> b.source AND a.canon <> b.canon),
    cq AS (SELECT *, CASE WHEN length(ta) <= length(tb) THEN na ELSE nb END >= 70 AND (CASE WHEN length(ta) <= length(tb) THEN starts_with(tb, ta) ELSE starts_with(ta, tb) END) AS cut,
           len(list_intersect(string_split(ta, ' '), string_split(tb, ' '))) / len(list_distinct(list_concat(string_split(ta, ' '), string_split(tb, ' ')))) AS jac FROM cp),
    cpairs AS (SELECT a, b, CASE WHEN cut THEN 'cut' ELSE 'alike' END AS kind FROM cq WHERE CASE WHEN cut THEN sim IS NULL OR sim >= 0.6 ELSE jac >= 0.6 AND sim >= 0.9 END)"""


@query(f"WITH {_REPOSTS_SQL}, {_KEYED_SQL}, {_HEADS_SQL}, {_COMPANY_PAIRS_SQL} SELECT * FROM cpairs")
def company_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.company_pairs(resolve.with_keys(with_reposts(spark, sf_dir), F.md5))


# company names differ by supplier, by 'labs' (a strong match) and by 'marine' (a weak one)
_TITLE_PAIRS_SQL = f"""
    th AS (SELECT canon, co, min(seq) AS seq, any_value(cw) AS cw FROM ks GROUP BY canon, co),
    tpairs AS (SELECT least(a.seq, b.seq) AS a, greatest(a.seq, b.seq) AS b, 'strong' AS kind FROM th a JOIN th b ON a.canon = b.canon AND a.co < b.co
               WHERE a.cw[1] = b.cw[1] AND NOT list_contains(a.cw, 'marine') AND NOT list_contains(b.cw, 'marine')
               UNION ALL SELECT a.seq, b.seq, 'weak' FROM heads a JOIN heads b ON a.canon = b.canon AND a.co <> b.co AND a.seq < b.seq AND a.source <> b.source AND a.cw[1] = b.cw[1]
               WHERE (list_contains(a.cw, 'marine') OR list_contains(b.cw, 'marine')) AND len(list_intersect(a.cw, b.cw)) = least(len(a.cw), len(b.cw)) AND {_SIM} >= 0.6)"""


@query(f"WITH {_REPOSTS_SQL}, {_KEYED_SQL}, {_HEADS_SQL}, {_TITLE_PAIRS_SQL} SELECT * FROM tpairs")
def title_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.title_pairs(resolve.with_keys(with_reposts(spark, sf_dir), F.md5))


@query(
    f"WITH RECURSIVE {_REPOSTS_SQL}, {_KEYED_SQL}, {_HEADS_SQL}, {_COMPANY_PAIRS_SQL}, {_TITLE_PAIRS_SQL}"
    """, exact AS (SELECT seq AS a, min(seq) OVER (PARTITION BY co, canon) AS b, 'exact' AS kind FROM ks),
    e AS (SELECT a, b FROM cpairs UNION SELECT b, a FROM cpairs UNION SELECT a, b FROM tpairs UNION SELECT b, a FROM tpairs UNION SELECT a, b FROM exact UNION SELECT b, a FROM exact),
    r AS (SELECT seq AS x, seq AS y FROM ks UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
    SELECT x AS seq, min(y) AS cluster_id FROM r GROUP BY x"""
)
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.cluster_ids(with_reposts(spark, sf_dir), F.md5)


# one opening a step: h holds the home of every opening so far
_REPLAY_SQL = f"""
    op AS (SELECT row_number() OVER (ORDER BY o) AS k, * FROM (SELECT co, canon, min(seq) AS o, arg_min(cw, seq) AS cw FROM ks GROUP BY co, canon)),
    pk AS (SELECT op.k, seq, source, chars, length(ks.canon) AS nc, length(trim(title)) AS nt, s FROM ks JOIN op USING (co, canon)),
    lt AS (SELECT b.k, a.k AS x, CASE WHEN list_contains(a.cw, 'marine') OR list_contains(b.cw, 'marine') THEN 'weak' ELSE 'strong' END AS kind, '' AS ta, '' AS tb
           FROM op a JOIN op b ON a.canon = b.canon AND a.cw[1] = b.cw[1] AND a.k < b.k
           WHERE NOT (list_contains(a.cw, 'marine') OR list_contains(b.cw, 'marine')) OR len(list_intersect(a.cw, b.cw)) = least(len(a.cw), len(b.cw))),
    lc AS (SELECT b.k, a.k AS x, '' AS kind, a.canon AS ta, b.canon AS tb FROM op a JOIN op b ON a.co = b.co AND a.k < b.k),
    l AS (SELECT *, starts_with(ta, tb) OR starts_with(tb, ta) AS begins,
                 len(list_intersect(string_split(ta, ' '), string_split(tb, ' '))) / len(list_distinct(list_concat(string_split(ta, ' '), string_split(tb, ' ')))) >= 0.6 AS shares
          FROM (SELECT * FROM lt UNION ALL SELECT * FROM lc)),
    r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS h
          UNION ALL
          SELECT k + 1, list_append(h, coalesce(first(x ORDER BY kind = '', x) FILTER (WHERE takes), k + 1))
          FROM (SELECT k, h, x, kind, CASE
                    WHEN kind = 'strong' THEN true WHEN same THEN false
                    WHEN kind = 'weak' THEN coalesce(sim >= 0.6, false)
                    WHEN begins AND shown >= 70 THEN coalesce(sim >= 0.6, true)
                    ELSE shares AND coalesce(sim >= 0.9, false) END AS takes
                FROM (SELECT a.*, {_SIM} AS sim
                      FROM (SELECT r.k, any_value(r.h) AS h, l.x, any_value(kind) AS kind, any_value(begins) AS begins, any_value(shares) AS shares, bool_or(m.source = o.source) AS same,
                                   any_value(o.s) AS s, first(m.s ORDER BY m.chars DESC, m.seq) AS said,
                                   CASE WHEN any_value(o.nc) <= min(m.nc) THEN any_value(o.nt) ELSE first(m.nt ORDER BY m.nc, m.seq) END AS shown
                            FROM r JOIN pk o ON o.k = r.k + 1 JOIN op ON op.k = o.k AND op.o = o.seq
                                 LEFT JOIN l ON l.k = o.k AND r.h[l.x] = l.x LEFT JOIN pk m ON r.h[m.k] = l.x AND m.seq < o.seq
                            GROUP BY r.k, l.x) a, LATERAL (SELECT a.said AS s) b))
          GROUP BY k, h)"""


@query(
    f"WITH RECURSIVE {_REPOSTS_SQL}, {_KEYED_SQL}, {_REPLAY_SQL}"
    ", home AS (SELECT unnest(h) AS x, generate_subscripts(h, 1) AS k FROM (SELECT h FROM r ORDER BY k DESC LIMIT 1))"
    " SELECT pk.seq, s.o AS cluster_id FROM pk JOIN home USING (k) JOIN op s ON s.k = home.x"
)
def replay_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.clusters_by_replay(with_reposts(spark, sf_dir), F.md5)


def _ids_sql(n: int, rows: str, book: str) -> str:
    """Clusters of ``rows`` take ids one after the other, in order; ``used`` holds the ids that are gone."""
    return f"""
    c{n} AS MATERIALIZED (SELECT *, min(seq) OVER (PARTITION BY k) AS cid FROM w WHERE {rows}),
    a{n} AS (SELECT DISTINCT cid, unnest([rk, 'm:' || k]) AS alias FROM c{n}),
    b{n} AS (SELECT DISTINCT ON (cid) cid, rk, rk || '#' || md5(url) AS other FROM c{n} ORDER BY cid, direct DESC, partner = '' DESC, length(text) DESC, coalesce(salary_max, 0) <> 0 DESC, seq),
    h{n} AS MATERIALIZED (SELECT cid, uid, count(*) AS n FROM a{n} JOIN {book} USING (alias) GROUP BY ALL),
    w{n} AS MATERIALIZED (SELECT cid, list_concat(coalesce(ids, []), [rk, other, other || '-' || cid]) AS wishes, row_number() OVER (ORDER BY cid) AS place
             FROM b{n} LEFT JOIN (SELECT cid, list(uid ORDER BY n DESC, uid) AS ids FROM h{n} GROUP BY cid) USING (cid)),
    u{n} AS (SELECT 0::BIGINT AS place, NULL::BIGINT AS cid, NULL::VARCHAR AS uid, []::VARCHAR[] AS used
             UNION ALL
             SELECT place, cid, uid, list_append(used, uid) FROM (SELECT x.place, x.cid, list_filter(x.wishes, lambda i: NOT list_contains(u.used, i))[1] AS uid, u.used FROM u{n} u JOIN w{n} x ON x.place = u.place + 1)),
    i{n} AS MATERIALIZED (SELECT cid AS cluster_id, uid FROM u{n} WHERE cid IS NOT NULL)"""


@query(
    f"WITH RECURSIVE {STAR_SQL}, {_CANON_SQL}, w AS MATERIALIZED (SELECT p.*, array_to_string({_COMPANY}, '') || '|' || canon AS k, {_RAW_KEY} AS rk FROM p JOIN canon USING (seq)),"
    f" none AS (SELECT '' AS alias, '' AS uid WHERE false), {_ids_sql(1, 'seq % 2 = 0', 'none')},"
    f" book AS MATERIALIZED (SELECT alias, min(uid) AS uid FROM a1 JOIN i1 ON i1.cluster_id = a1.cid GROUP BY alias), {_ids_sql(2, 'true', 'book')} SELECT * FROM i2"
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: ids of the first half of the postings are remembered, then all are resolved. Ids need the lengths of texts only."""
    p, scratch = P(spark, sf_dir).withColumn("n_text", F.length("text")).drop("text"), Scratch(spark, "runs")
    half = scratch.table(resolve.clusters_by_closure(p.where("seq % 2 = 0"), exact_only=True), "first")
    none = spark.createDataFrame([], "alias string, uid string, seen long")
    book = resolve.remember(none, half, resolve.stable_ids(half, resolve.best_of_clusters(half, "n_text"), none, F.md5), now=1_700_000_000)
    book = scratch.table(book, "book")
    whole = scratch.table(resolve.clusters_by_closure(p, exact_only=True), "second")
    return resolve.stable_ids(whole, resolve.best_of_clusters(whole, "n_text"), book, F.md5)


# ---------------------------------------------------------------- matching and ranking


def searches(spark: SparkSession) -> DataFrame:
    base = {k.split(" ")[0]: None for k in matching.SEARCH_SCHEMA.split(", ")}
    rows = [
        base | {"search_id": 1, "target_roles": ["Small Ring", "Blue Bolt"], "remote_regions": ["Europe", "Asia"], "work_modes": ["remote"], "keywords": ["the", "remote"]},
        base | {"search_id": 2, "target_roles": ["Senior Hot Gear"], "locations": [("AFRICA", ""), ("", "AMERICA")], "seniority": ["senior"], "salary": (35_000.0, "EUR", "year")},
    ]
    names = list(base)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], matching.SEARCH_SCHEMA)


# each role's words, its deduction by order, and its head
_ROLE_SQL = """
    roles(search_id, role, w, pos, head) AS (VALUES (1, 'Small Ring', ['small', 'ring'], 0, 'ring'), (1, 'Blue Bolt', ['blue', 'bolt'], 1, 'bolt'), (2, 'Senior Hot Gear', ['hot', 'gear'], 0, 'gear')),
    tw AS (SELECT seq, list_filter(regexp_extract_all(lower(title), '[a-zà-ÿ0-9+#]+'), lambda x: length(x) > 1 AND NOT list_contains(['of', 'the', 'with', 'remote', 'and', 'for'], x)) AS t FROM p),
    rated AS (SELECT seq, search_id, role, pos, (len(list_filter(w, lambda x: list_contains(t, x))) / len(w)) * (CASE WHEN list_contains(t, head) THEN 1.0 ELSE 0.4 END) - 0.02 * pos AS share
              FROM tw CROSS JOIN roles),
    rm AS (SELECT DISTINCT ON (search_id, seq) search_id, seq, role, share FROM rated WHERE share > 0 ORDER BY search_id, seq, share DESC, pos)"""


@query(with_p(f", {_ROLE_SQL} SELECT search_id::BIGINT AS search_id, seq, role, round(share::DOUBLE, 6) AS share FROM rm"))
def role_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best role of every posting for every search that shares a role's word with it."""
    p = P(spark, sf_dir).select("seq", "title").withColumn("word", F.explode(F.array_distinct(T.words(c("title")))))
    s = searches(spark).select("search_id", "target_roles")
    asked = s.withColumn("word", F.explode(F.array_distinct(F.flatten(F.transform("target_roles", T.role_words)))))
    pairs = p.join(asked, "word").dropDuplicates(["search_id", "seq"])
    rated = pairs.select("search_id", "seq", matching.role_match(c("title"), c("target_roles")).alias("r")).where("r is not null")
    return rated.select("search_id", "seq", c("r.role").alias("role"), F.round("r.share", 6).alias("share"))


@query(with_p(f", {_ROLE_SQL} SELECT DISTINCT search_id::BIGINT AS search_id, seq FROM tw JOIN roles ON list_contains(t, head)"))
def role_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidates(P(spark, sf_dir), searches(spark))


_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_SCORE_SQL = f"""{_ROLE_SQL},
    j AS (SELECT rm.search_id, rm.role, rm.share, p.*, lower(location) AS loc, lower(text)[1:6000] || ' ' || lower(title) AS whole,
          remote OR regexp_matches(title, '(?i)\\bremote\\b') AS rem, {_TOP} AS top
          FROM rm JOIN p USING (seq) WHERE share >= 0.75 AND NOT regexp_matches(title, '(?i)\\bjunior\\b')),
    l AS (SELECT *, CASE
            WHEN search_id = 1 AND NOT rem THEN ''
            WHEN search_id = 1 AND regexp_matches(loc, '{_B}(europe|eu){_E}') THEN 'Europe'
            WHEN search_id = 1 AND regexp_matches(loc, '{_B}asia{_E}') THEN 'Asia'
            WHEN search_id = 2 AND regexp_matches(loc, '{_B}africa{_E}') THEN 'AFRICA'
            WHEN search_id = 2 AND regexp_matches(loc, '{_B}america{_E}') THEN 'AMERICA' ELSE '' END AS place,
            CASE WHEN search_id = 1 AND regexp_matches(whole, '{_B}the{_E}') THEN 'the' ELSE '' END AS hits FROM j),
    scored AS (SELECT search_id::BIGINT AS search_id, seq, role, CASE search_id WHEN 1 THEN 'remote' ELSE 'local' END AS loc_kind, place, hits, company, direct,
            floor(greatest(0, least(100, 55 * least(1.0, share) + CASE search_id WHEN 1 THEN 18 ELSE 20 END + CASE WHEN hits <> '' THEN 4 ELSE 0 END + CASE WHEN direct THEN 5 ELSE 0 END)))::INT AS score
        FROM l WHERE place <> '' AND (search_id <> 1 OR hits <> '' OR length(text) < 600) AND (search_id <> 2 OR top IS NULL OR top < 1000 OR top >= 31500))"""


@query(with_p(f", {_SCORE_SQL} SELECT search_id, seq, role, loc_kind, place, hits, score FROM scored"))
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(P(spark, sf_dir), searches(spark))
    return found.select("search_id", "seq", "role", "loc_kind", "place", F.array_join("hits", ",").alias("hits"), "score")


_DIGEST_SQL = f"""{_SCORE_SQL},
    s2 AS (SELECT *, row_number() OVER (PARTITION BY search_id, lower(company) ORDER BY score DESC, direct DESC, seq) AS k FROM scored WHERE score >= 70 AND seq % 10 <> 3),
    s3 AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, direct DESC, seq) AS rank FROM s2 WHERE k <= 2)
    SELECT search_id, seq, company, role, score, rank::INT AS rank FROM s3 WHERE rank <= 7"""


@query(with_p(f", {_DIGEST_SQL}"))
def digest_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: score postings for all searches, drop what was sent before, cap companies, take the best."""
    found = matching.match(P(spark, sf_dir), searches(spark)).withColumn("all_keys", F.array(c("seq").cast("string")))
    sent = found.where("seq % 10 = 3").select("search_id", c("seq").cast("string").alias("job_key"))
    return ranking.digest(ranking.not_sent(found, sent)).select("search_id", "seq", "company", "role", "score", "rank")


@query(
    with_p(""", a AS (SELECT *, location AS page, row_number() OVER (PARTITION BY location, lower(company) ORDER BY coalesce(posted, TIMESTAMP '1970-01-01') DESC, seq) AS k FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY coalesce(posted, TIMESTAMP '1970-01-01') DESC, seq) AS rank FROM a WHERE k <= 3)
    SELECT page, rank::INT AS rank, seq FROM b WHERE rank <= 25""")
)
def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(P(spark, sf_dir).withColumn("page", c("location"))).select("page", "rank", "seq")


@query(
    with_p(f""", t AS (SELECT seq, row_number() OVER (ORDER BY company LIKE 'Supplier#000000001%' DESC, direct DESC, {_LOC_SQL} = 'local' DESC, coalesce(posted, TIMESTAMP '1970-01-01') DESC, seq) AS rank FROM p)
    SELECT seq, rank::INT AS rank FROM t WHERE rank <= 25""")
)
def triage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P(spark, sf_dir).withColumn("profile", F.lit("a")).withColumn("company_id", T.company_key(c("company")))
    p = p.withColumn("loc_class", rules.location_class(PROFILE, c("location"), c("text"), c("remote")))
    return ranking.triage(p, ["supplier#000000001"]).select("seq", "rank")


_JUDGED_SQL = "judged AS (SELECT seq, source AS profile, (seq * 37 % 101)::INT AS total, CASE WHEN seq * 37 % 101 >= 75 THEN 'strong' WHEN seq * 37 % 101 >= 60 THEN 'possible' ELSE 'rejected' END AS status FROM p)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = (c("seq") * 37 % 101).cast("int")
    status = F.when(total >= 75, "strong").when(total >= 60, "possible").otherwise("rejected")
    return P(spark, sf_dir).select("seq", c("source").alias("profile"), total.alias("total"), status.alias("status"))


@query(
    with_p(f""", {_JUDGED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY profile, status ORDER BY total DESC, seq) AS rank FROM judged)
    SELECT profile, status, seq, total, rank::INT AS rank FROM r WHERE rank <= CASE status WHEN 'strong' THEN 3 WHEN 'possible' THEN 2 ELSE 0 END""")
)
def capped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.capped_sections(_judged(spark, sf_dir), {"strong": 3, "possible": 2}).select("profile", "status", "seq", "total", "rank")


@query(
    with_p(f""", {_JUDGED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY total DESC, seq) AS rank FROM judged WHERE status = 'rejected' AND total >= 45)
    SELECT profile, seq, total, rank::INT AS rank FROM r WHERE rank <= 5""")
)
def notable_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.notable_rejects(_judged(spark, sf_dir), 60).select("profile", "seq", "total", "rank")


@query(with_p(f", {_JUDGED_SQL} SELECT profile, count(*) FILTER (status = 'strong') AS strong, count(*) FILTER (status = 'possible') AS possible, count(*) FILTER (status = 'rejected') AS rejected FROM judged GROUP BY profile"))
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [F.count_if(c("status") == s).alias(s) for s in ("strong", "possible", "rejected")]
    return _judged(spark, sf_dir).groupBy("profile").agg(*n)


@query(with_p("SELECT source, seq, (floor((row_number() OVER (PARTITION BY source ORDER BY seq) - 1) / 20))::INT AS batch FROM p"))
def model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.batches(P(spark, sf_dir).select("source", "seq"), ["source"], [c("seq")], 20)


# ---------------------------------------------------------------- joins and sets


@query(
    with_p(f""", k AS (SELECT seq, company, CASE WHEN len({_COMPANY}) > 1 AND ({_COMPANY})[-1] = 'labs' THEN array_to_string(({_COMPANY})[:-2], '') ELSE array_to_string({_COMPANY}, '') END AS company_id, direct FROM p),
    g AS (SELECT company_id, arg_min(company, seq) AS company, count(*) AS postings FROM k GROUP BY company_id)
    SELECT * FROM g WHERE company_id NOT IN (SELECT company_id FROM k WHERE seq % 20 = 3) AND company_id NOT IN (SELECT company_id FROM k WHERE seq % 20 = 6)""")
)
def uncovered_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = P(spark, sf_dir).select("seq", T.company_key(c("company")).alias("company_id"))
    return discovery.uncovered(discovery.companies_of(P(spark, sf_dir)), keyed.where("seq % 20 = 3"), keyed.where("seq % 20 = 6"))


@query(
    with_p(""", prev AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN seq % 5 = 0 THEN NULL ELSE 'r' || (seq % 2) END AS rubric FROM p WHERE seq % 4 <> 1)
    SELECT p.seq FROM p LEFT JOIN prev ON p.seq = prev.seq AND prev.version = 2 AND (rubric IS NULL OR rubric = 'r1') WHERE prev.seq IS NULL""")
)
def reassess_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17/ST-10: postings without a judgement of this version and rubric."""
    p = P(spark, sf_dir).select("seq")
    rubric = F.when(c("seq") % 5 != 0, F.concat(F.lit("r"), (c("seq") % 2).cast("string")))
    prev = p.where("seq % 4 <> 1").select("seq", F.when(c("seq") % 3 == 0, 2).otherwise(1).alias("version"), rubric.alias("rubric"))
    return p.join(prev.where("version = 2 and (rubric is null or rubric = 'r1')"), "seq", "left_anti")


@query(
    with_p("""SELECT 'union' AS op, company FROM (SELECT company FROM p WHERE seq % 2 = 0 UNION SELECT company FROM p WHERE seq % 3 = 0)
    UNION ALL SELECT 'intersect', company FROM (SELECT company FROM p WHERE seq % 2 = 0 INTERSECT SELECT company FROM p WHERE seq % 3 = 0)
    UNION ALL SELECT 'except', company FROM (SELECT company FROM p WHERE seq % 2 = 0 EXCEPT SELECT company FROM p WHERE seq % 3 = 0)
    UNION ALL SELECT 'union all', company FROM (SELECT company FROM p WHERE seq % 2 = 0 UNION ALL SELECT company FROM p WHERE seq % 3 = 0)""")
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P(spark, sf_dir)
    a, b = (p.where(f"seq % {n} = 0").select("company") for n in (2, 3))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union all": a.union(b)}
    frames = [f.select(F.lit(k).alias("op"), "company") for k, f in parts.items()]
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


@query(
    """WITH n AS (SELECT lower(n_name) AS country, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation)
    SELECT DISTINCT q AS query, country FROM n, (SELECT unnest(['data engineer', 'analyst']) AS q) WHERE k <= 2"""
)
def distinct_partner_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22: a search for each region, its nations as countries."""
    s = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("countries"))
    return catalog.partner_requests(s.withColumn("search_queries", T.lit_array([" Data  Engineer", "data engineer", "Analyst", "fourth is not asked"])))


CATALOG = [
    (0, "alpha", "Alpha", "https://a.example/?q={q}", "https://a.example/?q={q}&l={where}", [], [], [], []),
    (1, "beta", "Beta", "https://b.example/{q_slug}", None, [], ["english"], [], []),
    (2, "gamma", "Gamma", "https://c.example/{q_slug}", "https://c.example/{where_slug}/{q_slug}", ["nation_3"], [], [], ["ring"]),
]


@query(
    """WITH s AS (SELECT n_nationkey::BIGINT AS search_id, n_name AS place FROM nation),
    r AS (SELECT search_id, 'gamma' AS id, 'Gamma' AS name, 'https://c.example/nation_3/small-ring' AS url, place AS "where", 0 AS o FROM s WHERE search_id = 3
          UNION ALL SELECT search_id, 'alpha', 'Alpha', 'https://a.example/?q=Small+Ring&l=' || place, place, 1 FROM s
          UNION ALL SELECT search_id, 'beta', 'Beta', 'https://b.example/small-ring', '', 2 FROM s WHERE search_id % 2 = 0)
    SELECT search_id, id, name, url, "where", (row_number() OVER (PARTITION BY search_id ORDER BY o))::INT AS rank FROM r"""
)
def external_search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = c("n_name")
    spoken = F.when(c("n_nationkey") % 2 == 0, catalog.languages(T.lit_array(["Englisch (fluent)", "Klingon"]))).otherwise(catalog.languages(T.lit_array([]).cast("array<string>"), F.lit("de")))
    s = _read(spark, sf_dir, "nation").select(
        c("n_nationkey").cast("long").alias("search_id"), F.lit("Small Ring").alias("query"), name.alias("place"), catalog.countries(F.array(name)).alias("countries"),
        spoken.alias("languages"), F.array().cast("array<string>").alias("types"), F.lit("small ring").alias("blob"),
    )
    return catalog.suggest(s, spark.createDataFrame(CATALOG, catalog.CATALOG_SCHEMA))


@query(
    with_p("""SELECT company, array_to_string(list_distinct_ordered, '; ') AS titles FROM (
        SELECT company, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (
            SELECT company, list(title ORDER BY seq)[1:3] AS l FROM p GROUP BY company))""")
)
def company_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.titles_of_companies(P(spark, sf_dir))


# ---------------------------------------------------------------- counts, votes and feedback


@query(
    """WITH d AS (SELECT event_type AS kind, 'user' || (user_id % 7) AS source, ts::DATE AS day, count(*) AS clicks FROM events GROUP BY ALL)
    SELECT kind, source, sum(clicks)::BIGINT AS clicks FROM d WHERE day >= DATE '2024-01-10' GROUP BY kind, source"""
)
def click_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("source", F.concat(F.lit("user"), (c("user_id") % 7).cast("string")))
    daily = e.groupBy(c("event_type").alias("kind"), "source", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("clicks"))
    return feedback.counter_report(daily, ["kind", "source"], ["clicks"], F.lit("2024-01-10").cast("date"))


@query(
    """WITH s AS (SELECT 'c' || (user_id % 5) AS campaign, count(*) FILTER (event_type = 'view') AS visits, count(*) FILTER (event_type = 'signup') AS signups,
        count(*) FILTER (event_type = 'purchase') AS confirmed, count(*) FILTER (event_type = 'error') AS failed FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY ALL)
    SELECT *, round(confirmed / nullif(visits, 0), 9) AS rate FROM s"""
)
def campaign_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"visits": "view", "signups": "signup", "confirmed": "purchase", "failed": "error"}
    e = _read(spark, sf_dir, "events").withColumn("campaign", T.campaign_name(F.concat(F.lit("C"), (c("user_id") % 5).cast("string"))))
    daily = e.groupBy("campaign", F.to_date("ts").alias("day")).agg(*[F.count_if(c("event_type") == k).alias(n) for n, k in kinds.items()])
    out = feedback.counter_report(daily, ["campaign"], list(kinds), F.lit("2024-01-05").cast("date"))
    return out.withColumn("rate", F.round(feedback.rate(c("confirmed"), c("visits")), 9))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy(_day("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.read_events(spark, f"{sf_dir}/events.parquet*", jobs.EVENTS.replace("ts timestamp", "ts timestamp_ntz"), 8)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stream")
    counts = jobs.daily_counts(_stream(spark, sf_dir).withColumn("ts", c("ts").cast("timestamp")), "event_type")
    table = jobs.run_to_files(counts, scratch.folder("counts"), scratch.folder("checkpoint"), complete=True)
    return table.select(_day("day").alias("day"), "event_type", "n")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id % 4 AS user_id, ts, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT event_id, user_id, ts, k, true AS allowed, [ts] AS recent FROM e WHERE k = 1
          UNION ALL
          SELECT e.event_id, e.user_id, e.ts, e.k, len(list_filter(r.recent, lambda x: x > e.ts - INTERVAL 1 HOUR)) < 5,
                 CASE WHEN len(list_filter(r.recent, lambda x: x > e.ts - INTERVAL 1 HOUR)) < 5 THEN list_append(list_filter(r.recent, lambda x: x > e.ts - INTERVAL 1 HOUR), e.ts)
                      ELSE list_filter(r.recent, lambda x: x > e.ts - INTERVAL 1 HOUR) END
          FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT event_id, user_id, epoch_us(ts) AS hit_at, allowed FROM r"""
)
def rate_limit_5_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-02 for four callers, each busy enough to meet the limit."""
    scratch = Scratch(spark, "stream")
    stream = _stream(spark, sf_dir).withColumn("user_id", c("user_id") % 4)
    table = jobs.run_to_files(jobs.rate_limit(stream, 5, 3600), scratch.folder("hits"), scratch.folder("checkpoint"))
    return table.select("event_id", "user_id", F.unix_micros(c("ts").cast("timestamp")).alias("hit_at"), "allowed")


@query(
    """WITH RECURSIVE s AS (SELECT event_id, user_id, event_type, epoch_us(TIMESTAMP '2024-01-01') + 12 * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) AS t FROM events),
    e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS k FROM s),
    r AS (SELECT event_id, user_id, event_type, t, k, true AS shown, t AS latest FROM e WHERE k = 1
          UNION ALL
          SELECT e.event_id, e.user_id, e.event_type, e.t, e.k, r.latest <= e.t - 2592000000000, CASE WHEN r.latest <= e.t - 2592000000000 THEN e.t ELSE r.latest END
          FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1)
    SELECT event_id, user_id, event_type, t AS shown_at FROM r WHERE shown"""
)
def repeat_after_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-03 over a year: time runs twelve times as fast as in the table, so that items come back."""
    scratch = Scratch(spark, "stream")
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    micros = F.unix_micros(c("ts").cast("timestamp"))
    stream = _stream(spark, sf_dir).withColumn("ts", F.timestamp_micros(start + 12 * (micros - start)))
    table = jobs.run_to_files(jobs.repeat_after(stream, 30), scratch.folder("shown"), scratch.folder("checkpoint"))
    return table.select("event_id", "user_id", "event_type", F.unix_micros(c("ts").cast("timestamp")).alias("shown_at"))


_VOTES_SQL = """v AS (SELECT user_id % 20 AS search_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'up' WHEN event_id % 3 = 1 THEN 'down' END AS feedback,
    CASE event_id % 7 WHEN 1 THEN 'not this company' WHEN 2 THEN 'not my field; too junior' WHEN 3 THEN 'wrong location' WHEN 4 THEN 'salary too low' WHEN 5 THEN 'too senior' END AS feedback_reason,
    p.company, p.title, p.location, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'role ' || (event_id % 3) END AS matched_role, epoch_us(ts) AS feedback_at
    FROM events JOIN p ON p.seq = event_id % (SELECT count(*) FROM documents))"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _read(spark, sf_dir, "events"), c("event_id")
    reason = F.coalesce(*[F.when(i % 7 == k, r) for k, r in ((1, "not this company"), (2, "not my field; too junior"), (3, "wrong location"), (4, "salary too low"), (5, "too senior"))])
    v = e.join(P(spark, sf_dir).select("seq", "company", "title", "location"), c("seq") == i % _read(spark, sf_dir, "documents").count())
    return v.select(
        (c("user_id") % 20).alias("search_id"), "event_id", F.when(i % 3 == 0, "up").when(i % 3 == 1, "down").alias("feedback"), reason.alias("feedback_reason"), "company", "title", "location",
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("role "), (i % 3).cast("string"))).alias("matched_role"), F.unix_micros(c("ts").cast("timestamp")).alias("feedback_at"),
    )


@query(
    with_p(f""", {_VOTES_SQL}, x AS (SELECT *, CASE WHEN feedback = 'down' THEN coalesce(feedback_reason, '') ELSE '' END AS r FROM v WHERE feedback IS NOT NULL),
    roles AS (SELECT search_id, matched_role, count(*) FILTER (feedback = 'up') AS u, count(*) FILTER (contains(r, 'not my field')) AS d FROM x WHERE matched_role <> '' GROUP BY ALL),
    m AS (SELECT search_id, string_agg(matched_role || '=' || u, ',' ORDER BY matched_role) FILTER (u > 0) AS role_up, string_agg(matched_role || '=' || d, ',' ORDER BY matched_role) FILTER (d > 0) AS role_down FROM roles GROUP BY search_id),
    lw AS (SELECT search_id, string_agg(DISTINCT w, ',' ORDER BY w) AS liked_words FROM (SELECT search_id, unnest(regexp_extract_all(lower(title), '[a-zà-ÿ0-9+#]+')) AS w FROM x WHERE feedback = 'up') WHERE length(w) > 2 GROUP BY search_id),
    f AS (SELECT search_id, coalesce(string_agg(DISTINCT lower(company), ',' ORDER BY lower(company)) FILTER (contains(r, 'not this company')), '') AS excluded_companies,
        bool_or(contains(r, 'too junior')) AS too_junior, bool_or(contains(r, 'too senior')) AS too_senior, bool_or(contains(r, 'salary too low')) AS salary_strict,
        coalesce(string_agg(DISTINCT lower(split_part(location, ',', 1)), ',' ORDER BY lower(split_part(location, ',', 1))) FILTER (contains(r, 'wrong location')), '') AS bad_places FROM x GROUP BY search_id)
    SELECT f.*, coalesce(role_up, '') AS role_up, coalesce(role_down, '') AS role_down, coalesce(liked_words, '') AS liked_words FROM f LEFT JOIN m USING (search_id) LEFT JOIN lw USING (search_id)""")
)
def feedback_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = feedback.signals(_votes(spark, sf_dir))
    shown = lambda n: F.array_join(F.transform(F.map_entries(n), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(n)
    joined = [F.array_join(n, ",").alias(n) for n in ("excluded_companies", "bad_places", "liked_words")]
    return s.select("search_id", "too_junior", "too_senior", "salary_strict", *joined, shown("role_up"), shown("role_down"))


@query(
    with_p(f""", {_VOTES_SQL} SELECT search_id, count(*) FILTER (feedback = 'up') OVER w AS up, count(*) FILTER (feedback = 'down') OVER w AS down, event_id, title, feedback
    FROM v WHERE feedback IS NOT NULL WINDOW w AS (PARTITION BY search_id)""")
)
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.summary(_votes(spark, sf_dir)).select("search_id", "up", "down", "event_id", "title", "feedback")


@query(with_p(f", {_VOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY feedback_at DESC, event_id DESC) AS rank FROM v) SELECT search_id, event_id, rank::INT AS rank FROM r WHERE rank <= 30"))
def recent_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.recent(_votes(spark, sf_dir), "search_id", "feedback_at", "event_id").select("search_id", "event_id", "rank")


@query(
    with_p(f""", {_VOTES_SQL}, k AS (SELECT search_id AS profile, feedback, coalesce(feedback_reason, '') AS reason, regexp_replace(lower(company), '[ ](gmbh|ltd|labs)$', '') AS ck,
        trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '(?i){V.GENDER_TAG_VERDICT}', ' ', 'g')), '\\s+', ' ', 'g'), '^[ ,|·–-]+|[ ,|·–-]+$', '', 'g')) AS tn FROM v),
    g AS (SELECT profile, list_sort(list_distinct(coalesce(list(tn) FILTER (feedback = 'down' AND list_contains(string_split(reason, '; '), 'not my field')), []))) AS bt,
        list_sort(list_distinct(coalesce(list(tn) FILTER (feedback = 'up'), []))) AS lt, list_sort(list_distinct(coalesce(list(ck) FILTER (feedback = 'down' AND contains(reason, 'not this company')), []))) AS bc,
        list_sort(list_distinct(coalesce(list(ck) FILTER (feedback = 'up'), []))) AS lc FROM k GROUP BY profile)
    SELECT profile, array_to_string(bt, ';') AS blocked_titles, array_to_string(lt, ';') AS liked_titles, array_to_string(bc, ';') AS blocked_companies,
           array_to_string(list_filter(lc, lambda x: NOT list_contains(bc, x)), ';') AS liked_companies FROM g""")
)
def votes_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _votes(spark, sf_dir).withColumnsRenamed({"search_id": "profile", "feedback": "vote", "feedback_reason": "reason"})
    out = feedback.rules_from_votes(v, ["not my field"], "not this company")
    return out.select("profile", *[F.array_join(n, ";").alias(n) for n in ("blocked_titles", "liked_titles", "blocked_companies", "liked_companies")])


@query(with_p(f", {_VOTES_SQL} SELECT matched_role AS sponsor, count(*) AS shown, sum((feedback = 'up')::INT)::BIGINT AS liked FROM v WHERE matched_role <> '' GROUP BY matched_role"))
def sponsored_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.sponsored_stats(_votes(spark, sf_dir).withColumn("sponsor", F.nullif(c("matched_role"), F.lit(""))))


@query(
    """WITH a AS (SELECT event_id, (event_id % 12)::INT - 1 AS fit, (event_id % 9)::INT AS skill FROM events)
    SELECT event_id, greatest(0, round_even(100.0 * (greatest(0, least(10, fit)) + greatest(0, least(6, skill)) - CASE WHEN event_id % 4 = 0 THEN 6 WHEN event_id % 4 = 1 THEN 3 ELSE 0 END) / 16, 0)::INT) AS total FROM a"""
)
def rubric_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c("event_id")
    scores = F.create_map(F.lit("fit"), (i % 12 - 1).cast("string"), F.lit("skill"), (i % 9).cast("string"))
    fines = F.when(i % 4 == 0, T.lit_array(["late", "late"])).when(i % 4 == 1, T.lit_array(["late", "unknown"])).otherwise(F.array().cast("array<string>"))
    return _read(spark, sf_dir, "events").select("event_id", feedback.rubric_total(scores, {"fit": 10, "skill": 6}, fines, {"late": 3}).alias("total"))


@query(
    """WITH a AS (SELECT event_id, (event_id % 101)::INT AS total FROM events)
    SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'rejected' WHEN event_id % 11 = 0 THEN 'rejected' WHEN event_id % 5 = 0 THEN CASE WHEN total >= 60 THEN 'contract' ELSE 'rejected' END
        WHEN total >= 75 AND event_id % 2 = 0 THEN 'strong' WHEN total >= 60 THEN 'possible' ELSE 'rejected' END AS status,
        CASE WHEN event_id % 13 = 0 THEN 'agency' WHEN event_id % 11 = 0 THEN 'location not eligible' WHEN total < 60 THEN 'score ' || total ELSE '' END AS reason FROM a"""
)
def classify_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c("event_id")
    a = F.struct(
        F.when(i % 13 == 0, "agency").alias("exclusion_reason"), F.lit(None).cast("boolean").alias("employer_identified"), F.lit(True).alias("is_specific_job"),
        F.when(i % 11 == 0, "ineligible").when(i % 2 == 0, "explicit").otherwise("likely").alias("location_eligibility"),
        F.when(i % 5 == 0, "interim").otherwise("permanent").alias("job_type"), (i % 101).cast("int").alias("total"),
    )
    return _read(spark, sf_dir, "events").select("event_id", a.alias("a")).select("event_id", feedback.classify(c("a"), F.lit(False)).alias("s")).select("event_id", "s.status", "s.reason")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
    SELECT conv_id, string_agg(upper(role) || ': ' || text[1:200], chr(10) ORDER BY turn) AS prompt FROM r WHERE k <= 3 GROUP BY conv_id"""
)
def conversation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-43/RK-07: the last turns of each conversation as one prompt."""
    last = feedback.recent(_read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", 3)
    line = F.concat(F.upper("role"), F.lit(": "), F.left("text", F.lit(200)))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("prompt"))


@query(
    """SELECT doc_id, CASE WHEN lang IN ('en', 'es', 'fr') AND doc_id % 10 >= 5 THEN lang ELSE 'de' END AS lang FROM documents"""
)
def negotiate_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-35: each document's own language at a weight of 0.0 to 0.9, and German at 0.5."""
    weight = F.concat(F.lit(";q=0."), (c("doc_id") % 10).cast("string"), F.lit(", xx, de;q=0.5"))
    header = F.concat(F.coalesce("lang", F.lit("zz")), F.lit("-"), F.upper(F.coalesce("lang", F.lit("zz"))), weight)
    return _read(spark, sf_dir, "documents").select("doc_id", feedback.negotiate(header, ("en", "de", "es", "fr")).alias("lang"))


# ---------------------------------------------------------------- state

_OLD_SQL = "old AS (SELECT user_id, event_type, arg_min(value, event_id) AS value, 'model' AS origin, min(event_id) AS first_id FROM events WHERE event_id % 2 = 0 GROUP BY ALL)"


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _read(spark, sf_dir, "events")
    old = e.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"), F.lit("model").alias("origin"), F.min("event_id").alias("first_id"))
    new = e.where("event_id % 2 = 1").select("user_id", "event_type", "value", F.when(c("event_id") % 3 == 0, "you").otherwise("model").alias("origin"), c("event_id").alias("first_id"), c("event_id").alias("arrival"))
    return old, new


@query(
    f"""WITH {_OLD_SQL}, b AS (SELECT user_id, event_type, value, origin, first_id, -1 AS arrival FROM old UNION ALL
        SELECT user_id, event_type, value, CASE WHEN event_id % 3 = 0 THEN 'you' ELSE 'model' END, event_id, event_id FROM events WHERE event_id % 2 = 1)
    SELECT user_id, event_type, arg_max(value, arrival) AS value, arg_max(origin, arrival) AS origin, arg_min(first_id, arrival) AS first_id FROM b GROUP BY ALL"""
)
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_wins(*_old_and_new(spark, sf_dir), ["user_id", "event_type"], keep_first=["first_id"])


@query(
    f"""WITH {_OLD_SQL}, b AS (SELECT user_id, event_type, value, origin, first_id, -1 AS arrival FROM old UNION ALL
        SELECT user_id, event_type, value, CASE WHEN event_id % 3 = 0 THEN 'you' ELSE 'model' END, event_id, event_id FROM events WHERE event_id % 2 = 1)
    SELECT DISTINCT ON (user_id, event_type) user_id, event_type, value, origin, first_id FROM b ORDER BY user_id, event_type, origin = 'you' DESC, arrival DESC"""
)
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.guarded(*_old_and_new(spark, sf_dir), ["user_id", "event_type"])


@query(
    f"""WITH {_OLD_SQL}, b AS (SELECT user_id, event_type, value, origin, first_id, -1 AS arrival FROM old UNION ALL
        SELECT user_id, event_type, CASE WHEN event_id % 5 = 1 THEN NULL ELSE value END, CASE WHEN event_id % 3 = 0 THEN 'you' ELSE 'model' END, event_id, event_id FROM events WHERE event_id % 2 = 1)
    SELECT user_id, event_type, arg_max(value, arrival) FILTER (value IS NOT NULL) AS value, arg_max(origin, arrival) AS origin, arg_min(first_id, arrival) AS first_id FROM b GROUP BY ALL"""
)
def preserve_first_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    new = new.withColumn("value", F.when(c("arrival") % 5 != 1, c("value")))
    return state.preserve_first(old, new, ["user_id", "event_type"], ["first_id"], ["value"])


@query(
    """WITH o AS (SELECT user_id, event_type, event_id FROM events WHERE event_id % 100 < 5), old AS (SELECT user_id, event_type, min(event_id) AS first_id FROM o GROUP BY ALL),
    n AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events WHERE event_id % 100 >= 5 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM old) GROUP BY ALL)
    SELECT * FROM old UNION ALL SELECT * FROM n"""
)
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", c("event_id").alias("first_id"), c("event_id").alias("arrival"))
    old = e.where("first_id % 100 < 5").groupBy("user_id", "event_type").agg(F.min("first_id").alias("first_id"))
    return state.insert_or_ignore(old, e.where("first_id % 100 >= 5"), ["user_id", "event_type"])


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def ttl_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("ts", c("ts").cast("timestamp"))
    return state.prune(e, c("ts"), F.lit("2024-01-31").cast("timestamp"), F.make_dt_interval(F.lit(10))).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey % 7 = 0)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' or o_orderkey % 7 = 0")
    return state.cascade(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey", "o_orderkey")


@query(
    """WITH d AS (SELECT ts::DATE AS day, user_id, count(*) AS n, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS i FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY t, i) AS k FROM d)
    SELECT strftime(day, '%Y-%m-%d') AS day, user_id, n FROM r WHERE k <= 20"""
)
def guarded_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.count_with_guard(_read(spark, sf_dir, "events"), "user_id", "ts", 20).withColumn("day", _day("day"))


@query(
    """WITH t AS (SELECT event_id AS task_id, CASE event_id % 4 WHEN 0 THEN 'pending' ELSE 'running' END AS status, (event_id % 6)::INT AS attempts FROM events),
    o AS (SELECT *, CASE WHEN task_id % 5 < 2 THEN true WHEN task_id % 5 < 4 THEN false END AS ok FROM t)
    SELECT task_id, attempts, CASE WHEN status <> 'running' OR ok IS NULL THEN status WHEN ok THEN 'done' WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS status,
        CASE WHEN status = 'running' AND NOT ok AND attempts < 5 THEN (60 * pow(2, attempts - 1))::BIGINT END AS wait FROM o"""
)
def task_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, now = c("event_id"), F.lit("2024-01-01").cast("timestamp")
    status = F.when(i % 4 == 0, "pending").otherwise("running")
    tasks = _read(spark, sf_dir, "events").select(i.alias("task_id"), status.alias("status"), (i % 6).cast("int").alias("attempts"), F.lit(None).cast("timestamp").alias("run_after"))
    outcomes = tasks.where("task_id % 5 < 4").select("task_id", (c("task_id") % 5 < 2).alias("ok"))
    out = state.step_tasks(tasks, outcomes, now)
    return out.select("task_id", "attempts", "status", (F.unix_timestamp("run_after") - F.unix_timestamp(now)).alias("wait"))
