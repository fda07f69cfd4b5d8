"""Queries over the driver's tables, each over its whole tables, and the same in DuckDB SQL where SQL can say it.

The corpus is ``documents``; query texts are ``benchmark``, or the documents themselves.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from passages.functions import fingerprint as fp
from passages.operators import align, candidates as cand, highlight as hl, index as ix, metadata as md, perturb as pt, scoring as sc
from passages.params import METHODS, WEB, IndexParams, ScoreParams
from passages.plans import sql as S
from passages.sources import corpus
from passages.storage import shared_folder
from passages.streaming.indexing import index_stream

INDEX = IndexParams()
SCORE = ScoreParams()
FRAGMENT = 200.0
DONE = "event_type = 'purchase'"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return _read(spark, d, "documents")


_managers: dict[str, ix.IndexManager] = {}


def _index(spark, d) -> ix.Index:
    """The stored index of the documents: built by the session's first query that needs it, then read by all."""
    app = spark.sparkContext.applicationId
    manager = _managers.setdefault(app, ix.IndexManager(spark, most=2))
    name = hashlib.md5(f"{app} {d}".encode()).hexdigest()
    return manager.of(_docs(spark, d), f"{shared_folder(spark)}/index-{name}", INDEX, "doc_id")


def _items(spark, d) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _q(spark, d) -> DataFrame:
    return cand.query_fingerprints(_items(spark, d), INDEX)


def _self(spark, d) -> DataFrame:
    """All documents as queries."""
    return _docs(spark, d).select(F.col("doc_id").alias("query_id"), "text")


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


_BASE = (S.index(),)
_CAND = (*_BASE, S.CANDIDATES)
_PTS = (*_CAND, S.POINTS)
_SPACE = S.SPACES
_PHI = """round(CASE WHEN z = 0 THEN 0.5 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(abs(z)) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1))))) END, 6)"""


# -- sources and filters


@query(f"SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 2000 AND 100000 AND NOT list_has_any(regexp_split_to_array(text, '{_SPACE}'), ['sex', 'porn'])")
def clean_documents(spark, d):
    return corpus.clean(_docs(spark, d)).select("doc_id", "n_chars")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source, n_chars FROM documents")
def normalised_documents(spark, d):
    return corpus.normalise(_docs(spark, d))


@query("SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return _docs(spark, d).groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT lang, median(length(text)) AS median_length, count(*) AS n FROM documents GROUP BY 1")
def median_lengths(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.percentile(F.length("text"), 0.5).alias("median_length"), F.count("*").alias("n"))


# -- tokens, fingerprints, index


@query(_with(S.tokens("dt", "documents", "doc_id"), select="SELECT doc_id, pos, token FROM dt"))
def tokens(spark, d):
    return fp.token_rows(_docs(spark, d), "doc_id")


@query(_with(S.tokens("dt", "documents", "doc_id"), S.hashes("th", "dt"), select="SELECT doc_id, pos, h AS token_hash FROM dt JOIN th USING (token)"))
def token_hashes(spark, d):
    return fp.hash_rows(_docs(spark, d), INDEX, "doc_id")


@query(_with(S.tokens("dt", "documents", "doc_id"), S.hashes("th", "dt"), S.kgrams("dk", "dt", "th", "doc_id"), select="SELECT doc_id, pos, fp FROM dk"))
def kgram_fingerprints(spark, d):
    return fp.fingerprint_rows(_docs(spark, d), INDEX.for_queries(), "doc_id")


@query(_with(*_BASE, select="SELECT doc_id, pos, fp FROM post"))
def winnowed_index(spark, d):
    return ix.build_postings(_docs(spark, d), INDEX, "doc_id")


@query(_with(*_BASE, select="SELECT fp, count(DISTINCT doc_id) AS df, count(*) AS n FROM post GROUP BY fp"))
def inverted_index_df(spark, d):
    return _index(spark, d).stats.select("fp", "df", "n")


@query(_with(*_BASE, select="SELECT fp AS fingerprint, string_agg(doc_id || ':' || pos, ',' ORDER BY CAST(doc_id AS VARCHAR), pos) AS postings FROM post GROUP BY fp"))
def nested_postings(spark, d):
    nested = ix.nested_postings(_index(spark, d).postings)
    return nested.select("fingerprint", F.array_join(F.transform("postings", lambda x: F.concat(x["doc_id"], F.lit(":"), x["position"].cast("string"))), ",").alias("postings"))


@query(_with(*_BASE, select="SELECT num_documents, num_fingerprints, num_postings, round(1 - num_postings / num_fingerprints / num_documents, 9) AS mean_weight FROM (SELECT count(DISTINCT doc_id) AS num_documents, count(DISTINCT fp) AS num_fingerprints, count(*) AS num_postings FROM post)"))
def index_stats(spark, d):
    return ix.index_stats(_index(spark, d)).withColumn("mean_weight", F.round("mean_weight", 9))


# -- candidates


@query(_with(*_CAND, select="SELECT query_id, doc_id, n_shared, rank FROM cand"))
def candidates(spark, d):
    return cand.candidates(_q(spark, d), _index(spark, d).postings)


@query(_with(*_BASE, select="SELECT query_id, doc_id, CAST(count(*) AS BIGINT) AS n_shared FROM q JOIN post USING (fp) GROUP BY ALL"))
def match_counts_bag(spark, d):
    return cand.match_counts(_q(spark, d), _index(spark, d).postings, "bag")


@query(_with(*_CAND, select="SELECT query_id, doc_id FROM cand WHERE rank <= 5"))
def closest_matches(spark, d):
    return cand.closest(_q(spark, d), _index(spark, d).postings)


@query(_with(*_CAND, select="SELECT query_id, doc_id, fp, string_agg(pos, ',' ORDER BY pos) AS positions FROM cand JOIN (SELECT DISTINCT query_id, fp FROM q) USING (query_id) JOIN post USING (doc_id, fp) GROUP BY ALL"))
def shared_positions(spark, d):
    q, p = _q(spark, d), _index(spark, d).postings
    return cand.shared_positions(q, p, cand.candidates(q, p)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(_with(*_PTS, select="SELECT * FROM pts"))
def shared_points(spark, d):
    q, p = _q(spark, d), _index(spark, d).postings
    return cand.shared_points(q, p, cand.candidates(q, p))


# -- shared-count scores


@query(_with(*_CAND, select="SELECT query_id, doc_id, rank, CAST(n_shared AS DOUBLE) AS raw_score FROM cand"))
def shared_scores(spark, d):
    return sc.score_shared(_q(spark, d), _index(spark, d))


def _prob(sql_scores: str, score: str = "raw_score") -> str:
    n0 = FRAGMENT / (INDEX.window_size * 5.5)
    return f"SELECT query_id, doc_id, rank, round({score}, 6) AS raw_score, {_PHI} AS probability FROM (SELECT *, greatest(-8, least(8, ({score} - {n0!r}) / sqrt({n0!r}))) AS z FROM ({sql_scores}))"


def _probs(scores: DataFrame) -> DataFrame:
    return sc.with_probability(scores, INDEX.window_size, FRAGMENT).select("query_id", "doc_id", "rank", F.round("raw_score", 6).alias("raw_score"), F.round("probability", 6).alias("probability"))


@query(_with(*_CAND, select=_prob("SELECT query_id, doc_id, rank, CAST(n_shared AS DOUBLE) AS raw_score FROM cand")))
def shared_prob(spark, d):
    return _probs(sc.score_shared(_q(spark, d), _index(spark, d)))


_SHARED = "(SELECT query_id, doc_id, rank, fp FROM cand JOIN (SELECT DISTINCT query_id, fp FROM q) USING (query_id) JOIN (SELECT DISTINCT doc_id, fp FROM post) USING (doc_id, fp))"


@query(_with(*_CAND, S.RARITY, select=_prob(f"SELECT query_id, doc_id, rank, sum(rarity / mean) AS raw_score FROM {_SHARED} JOIN rar USING (fp), mean GROUP BY ALL")))
def rarity_scores_core(spark, d):
    return _probs(sc.score_shared(_q(spark, d), _index(spark, d), rarity_weighted=True))


@query(_with(*_CAND, S.RARITY, select=f"SELECT query_id, doc_id, rank, count(*) AS num_shared, round(sum(rarity), 6) AS rarity_sum FROM {_SHARED} JOIN rar USING (fp) GROUP BY ALL"))
def rarity_scores_web(spark, d):
    return sc.count_scores(_q(spark, d), _index(spark, d)).withColumn("rarity_sum", F.round("rarity_sum", 6))


@query(_with(*_BASE, S.CANDIDATES, select="SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n_shared DESC, rank) AS INTEGER) AS place, doc_id, n_shared AS score, round_even(n_shared / 8, 2) AS score_normalized FROM cand QUALIFY place <= 5"))
def ranking(spark, d):
    return sc.ranking(sc.score_shared(_q(spark, d), _index(spark, d)))


# -- chains


@query(_with(*_PTS, S.clusters(), select="SELECT query_id, doc_id, fp, pos_query, pos_doc, cluster_id FROM cl"))
def chain_clusters(spark, d):
    _, points = sc.chains(_q(spark, d), _index(spark, d))
    return points.select("query_id", "doc_id", "fp", "pos_query", "pos_doc", "cluster_id")


def _chain(method: str):
    def run(spark, d):
        return sc.score_chains(_q(spark, d), _index(spark, d), ScoreParams(method=method))

    run.__name__ = f"chain_scores_{method}"
    query(_with(*_PTS, S.clusters(method), S.CHAINS, select="SELECT query_id, doc_id, rank, raw_score FROM chain"))(run)


for _m in METHODS:
    _chain(_m)


@query(_with(*_PTS, S.clusters(), S.CHAINS, select=_prob("SELECT * FROM chain")))
def chain_prob(spark, d):
    return _probs(sc.score_chains(_q(spark, d), _index(spark, d)))


_WEIGHTED = "SELECT query_id, doc_id, rank, coalesce(max(s), 0.0) AS raw_score FROM cand LEFT JOIN (SELECT query_id, doc_id, cluster_id, sum(rarity / mean) AS s FROM (SELECT DISTINCT query_id, doc_id, cluster_id, fp FROM cl WHERE cluster_id >= 0) JOIN rar USING (fp), mean GROUP BY ALL) USING (query_id, doc_id) GROUP BY ALL"


@query(_with(*_PTS, S.clusters(), S.RARITY, select=_prob(_WEIGHTED)))
def chain_rarity_prob(spark, d):
    return _probs(sc.score_chains(_q(spark, d), _index(spark, d), rarity_weighted=True))


@query()
def chain_scores_self(spark, d):
    """Documents against the corpus they are in; the closure in SQL is too slow over whole tables, so tests hold it against brute force."""
    return sc.score_chains(cand.query_fingerprints(_self(spark, d), INDEX), _index(spark, d))


@query()
def chain_scores_reversed(spark, d):
    """The same with blocks of 20 words in reverse order: counts stay high and chains break."""
    turned = _self(spark, d).select("query_id", pt.reversed_blocks("text").alias("text"))
    return sc.score_both(cand.query_fingerprints(turned, INDEX), _index(spark, d))


@query()
def shuffled_scores(spark, d):
    """Seeded shuffles aren't SQL; tests hold them against the functions row by row."""
    turned = _items(spark, d).select("query_id", pt.shuffled("text", "word_blocks", 20).alias("text"))
    return sc.score_both(cand.query_fingerprints(turned, INDEX), _index(spark, d))


@query(
    _with(
        *_PTS, S.clusters(), S.RARITY,
        select=f"""SELECT query_id, doc_id, rank, num_shared, round(rarity_sum, 6) AS rarity_sum, coalesce(num_in_largest, 0) AS num_in_largest, round(coalesce(rarity_in_rarest, 0), 6) AS rarity_in_rarest
FROM (SELECT query_id, doc_id, rank, count(*) AS num_shared, sum(rarity) AS rarity_sum FROM {_SHARED} JOIN rar USING (fp) GROUP BY ALL)
LEFT JOIN (SELECT query_id, doc_id, max(n) AS num_in_largest, max(r) AS rarity_in_rarest FROM (SELECT query_id, doc_id, cluster_id, count(*) AS n, sum(rarity) AS r FROM (SELECT DISTINCT query_id, doc_id, cluster_id, fp FROM cl WHERE cluster_id >= 0) JOIN rar USING (fp) GROUP BY ALL) GROUP BY ALL) USING (query_id, doc_id)""",
    )
)
def web_cluster_metrics(spark, d):
    m = sc.cluster_metrics(_q(spark, d), _index(spark, d))
    return m.withColumn("rarity_sum", F.round("rarity_sum", 6)).withColumn("rarity_in_rarest", F.round("rarity_in_rarest", 6))


@query(_with(*_PTS, S.clusters(), S.CHAINS, select="SELECT query_id, doc_id, max(s) AS best FROM (SELECT query_id, doc_id, CAST(n_shared AS DOUBLE) AS s FROM cand UNION ALL SELECT query_id, doc_id, raw_score FROM chain) GROUP BY ALL HAVING max(s) > 0"))
def best_scores(spark, d):
    q, index = _q(spark, d), _index(spark, d)
    return sc.best_of(sc.score_shared(q, index), sc.score_chains(q, index))


# -- highlights

_ORDER = "ord AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n_unique DESC, f, cluster_id) - 1 AS INTEGER) AS place FROM (SELECT query_id, doc_id, cluster_id, count(DISTINCT fp) AS n_unique, min(pos_query) AS f FROM cl WHERE cluster_id >= 0 GROUP BY ALL))"
_LIT = "hp AS (SELECT DISTINCT query_id, doc_id, place, pos_query FROM cl JOIN ord USING (query_id, doc_id, cluster_id))"
#: Character spans of tokens: words between white space, cut to their first and last word characters.
_OFFSETS = rf"""ch AS (SELECT item_id AS query_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark),
cc AS (SELECT query_id, i, regexp_full_match(text[i:i], '[{S.SPACES[1:-2]}]') AS sp, regexp_full_match(text[i:i], '[\p{{L}}\p{{N}}_]') AS wd FROM ch),
wo AS (SELECT *, sum(CASE WHEN sp THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY i) AS g FROM cc),
tk AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g) - 1 AS INTEGER) AS pos, a, b FROM (SELECT query_id, g, min(i) - 1 AS a, max(i) AS b FROM wo WHERE wd GROUP BY ALL)),
nt AS (SELECT query_id, max(pos) AS last FROM tk GROUP BY ALL)"""


def _merged(keys: str) -> str:
    return f"""raw AS (SELECT DISTINCT {keys}, s.a AS s, e.b AS e FROM hp JOIN nt USING (query_id) JOIN tk s ON s.query_id = hp.query_id AND s.pos = pos_query JOIN tk e ON e.query_id = hp.query_id AND e.pos = least(pos_query + {INDEX.length - 1}, last)),
mk AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM raw),
isl AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM mk)"""


def _lit(spark, d, which="all"):
    _, points = sc.chains(_q(spark, d), _index(spark, d))
    return hl.positions(points, "clustering", which)


@query(_with(*_PTS, S.clusters(), _ORDER, _LIT, select="SELECT query_id, doc_id, place, pos_query FROM hp"))
def highlight_positions(spark, d):
    return _lit(spark, d)


@query(_with(*_PTS, S.clusters(), _ORDER, _LIT, _OFFSETS, _merged("hp.query_id, doc_id, place").replace("PARTITION BY hp.query_id", "PARTITION BY query_id"), select='SELECT query_id, doc_id, place, CAST(min(s) AS INTEGER) AS "start", CAST(max(e) AS INTEGER) AS "end" FROM isl GROUP BY query_id, doc_id, place, island'))
def highlight_spans(spark, d):
    return hl.spans(_lit(spark, d), _items(spark, d), INDEX.length)


@query(_with(*_PTS, S.clusters(), _ORDER, _LIT, _OFFSETS, _merged("hp.query_id, doc_id").replace("PARTITION BY hp.query_id", "PARTITION BY query_id"), select="SELECT query_id, doc_id, CAST(sum(y - x) AS BIGINT) AS matched_chars, round_even(100 * sum(y - x) / any_value(n), 1) AS coverage_pct FROM (SELECT query_id, doc_id, island, min(s) AS x, max(e) AS y FROM isl GROUP BY ALL) JOIN (SELECT item_id AS query_id, length(text) AS n FROM benchmark) USING (query_id) GROUP BY query_id, doc_id"))
def coverage(spark, d):
    return hl.coverage(_lit(spark, d), _items(spark, d), INDEX.length)


# -- metadata

_TITLE = "regexp_extract(html, '(?s)<title>([^<]*)</title>', 1)"
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)), '^www\.', '')"


def _titled(spark, d):
    return _read(spark, d, "pages").select("page_id", "url", md.html_title().alias("title"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def hosts(spark, d):
    return _read(spark, d, "pages").select("page_id", md.host("url").alias("host"))


@query(f"SELECT page_id, title FROM (SELECT page_id, {_TITLE} AS title FROM pages) WHERE contains(lower(title), 'the') ORDER BY NOT starts_with(lower(title), 'the'), lower(title), page_id LIMIT 20")
def title_search(spark, d):
    return md.title_search(_titled(spark, d).select("page_id", "title"), "The")


@query(f"SELECT page_id, url FROM (SELECT page_id, url, {_HOST} AS host, regexp_split_to_array(regexp_replace({_HOST}, '[^0-9a-z]+', ' ', 'g'), ' ') AS t FROM pages) WHERE list_contains(t, 'example') AND len(list_filter(t, lambda x: starts_with(x, 'co'))) > 0 ORDER BY host, url, page_id LIMIT 20")
def host_search(spark, d):
    return md.host_search(_read(spark, d, "pages").select("page_id", "url"), "example co")


@query(f"SELECT page_id, url, host FROM (SELECT page_id, url, {_HOST} AS host, regexp_split_to_array(regexp_replace({_HOST}, '[^0-9a-z]+', ' ', 'g'), ' ') AS t FROM pages) WHERE list_contains(t, 'example') AND len(list_filter(t, lambda x: starts_with(x, 'c'))) > 0 ORDER BY host, url, page_id LIMIT 20")
def host_search_stored(spark, d):
    path = _scratch(spark, d, "hosts")
    md.write_host_index(_read(spark, d, "pages").select("page_id", "url"), path)
    return md.search_host_index(spark, path, "example c").select("page_id", "url", "host")


@query("SELECT event_id, 'https://web.archive.org/web/' || strftime(ts, '%Y%m%d%H%M%S') || '/' || 'http://e.com/' || user_id AS link FROM events")
def wayback_links(spark, d):
    e = _read(spark, d, "events").select("event_id", F.concat(F.lit("http://e.com/"), F.col("user_id").cast("string")).alias("u"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    return e.select("event_id", md.wayback_url("u", "ts").alias("link"))


_KEY = f"sha1(trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g'))[1:2000])"


@query(f"WITH t AS (SELECT {_KEY} AS key, lang || '/' || source AS title FROM documents), k AS (SELECT key, min(title) AS title FROM t GROUP BY key HAVING min(title) = max(title)) SELECT doc_id, title FROM (SELECT doc_id, {_KEY} AS key FROM documents) JOIN k USING (key)")
def prefix_key_join(spark, d):
    titled = _docs(spark, d).select("text", F.concat_ws("/", "lang", "source").alias("title"))
    return md.prefix_join(_docs(spark, d), titled)


@query(f"SELECT key, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM (SELECT doc_id, {_KEY} AS key FROM documents) GROUP BY key")
def prefix_key_groups(spark, d):
    return md.key_groups(_docs(spark, d)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def antijoin_done(spark, d):
    return md.not_done(_docs(spark, d), _read(spark, d, "labels")).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semijoin_indexed(spark, d):
    return md.only_indexed(_docs(spark, d), _read(spark, d, "labels")).select("doc_id", "lang")


@query(_with(*_CAND, select="SELECT query_id, doc_id, n_shared, lang, source FROM cand LEFT JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)"))
def scores_with_metadata(spark, d):
    c = cand.candidates(_q(spark, d), _index(spark, d).postings).select("query_id", "doc_id", "n_shared")
    return md.with_metadata(c, _docs(spark, d).select("doc_id", "lang", "source"))


@query("SELECT CAST(page_id AS VARCHAR) AS id, url AS u FROM pages WHERE url <> ''")
def pages_with_url(spark, d):
    return md.with_url(_read(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("u")))


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type WHEN user_id % 2 = 0 THEN 'h' || user_id || '.org' ELSE 'document ' || event_id END AS label FROM events")
def labels(spark, d):
    e = _read(spark, d, "events")
    title = F.when(F.col("event_type") != "view", F.col("event_type"))
    url = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("http://www.h"), F.col("user_id").cast("string"), F.lit(".org/x")))
    return e.select("event_id", md.label(title, url, F.col("event_id"), F.col("event_id")).alias("label"))


@query(f"SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY host) > 1 THEN host || ' (' || row_number() OVER (PARTITION BY host ORDER BY page_id) || ')' ELSE host END AS numbered FROM (SELECT page_id, {_HOST} AS host FROM pages)")
def numbered_labels(spark, d):
    return md.numbered(_read(spark, d, "pages").select("page_id", md.host("url").alias("host")), "host", "page_id").select("page_id", "numbered")


@query("SELECT doc_id, topic, place FROM (SELECT doc_id, topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS INTEGER) AS place FROM (SELECT doc_id, 'en' AS topic FROM documents WHERE length(text) > 300 AND (contains(lower(text), 'tion') OR contains(lower(text), 'ing')) UNION ALL SELECT doc_id, 'de' FROM documents WHERE length(text) > 300 AND contains(lower(text), 'ung'))) WHERE place <= 12")
def topic_samples(spark, d):
    rows = _docs(spark, d).select("doc_id", F.col("text").alias("title"), F.col("text").alias("abstract"))
    return md.topics(rows, id_col="doc_id", keywords={"en": ("tion", "ing"), "de": ("ung",)})


@query(r"SELECT doc_id, array_to_string(list_reverse(list_transform(range(0, CAST(ceil(len(w) / 20) AS BIGINT)), lambda i: array_to_string(w[i * 20 + 1:i * 20 + 20], ' '))), ' ') AS text FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents)")
def reversed_blocks(spark, d):
    return _docs(spark, d).select("doc_id", pt.reversed_blocks("text").alias("text"))


# -- alignment and evaluation pairs: iterative, so tests hold them against a plain model


@query()
def align_regions(spark, d):
    """Local alignments of each query with its candidates' texts."""
    pairs = cand.candidates(_q(spark, d), _index(spark, d).postings).select("query_id", "doc_id")
    pairs = pairs.join(_items(spark, d).withColumnRenamed("text", "text1"), "query_id").join(_docs(spark, d).select("doc_id", F.col("text").alias("text2")), "doc_id")
    return align.align_pairs(pairs).select("query_id", "doc_id", F.explode("regions").alias("r")).select("query_id", "doc_id", "r.*")


@query()
def positive_pairs(spark, d):
    """Pairs of all documents that have a chunk to edit, by the operator's own defaults."""
    return pt.positive_pairs(_docs(spark, d), id_col="doc_id")


@query()
def negative_pairs(spark, d):
    """Of the benchmark's texts: over documents an alignment takes the square of up to 120,000 characters, up to 100 times a document. They are of 80 to 400
    characters, so the bound on the score is lower than the operator's own."""
    return pt.negative_pairs(_read(spark, d, "benchmark"), least_score=100, id_col="item_id")


# -- the same tables by way of files, streams and one-call functions


def _scratch(spark, d, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source, n_chars FROM documents")
def jsonl_scan(spark, d):
    """Documents written as gzipped JSON lines, with columns that are dropped again, and read."""
    path = _scratch(spark, d, "corpus") + ".jsonl.gz"
    corpus.copy_to(_docs(spark, d).withColumns({n: F.lit("x") for n in corpus.NOISE}), path)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in _docs(spark, d).schema), *(f"`{n}` string" for n in corpus.NOISE)])
    return corpus.normalise(corpus.read_corpus(spark, path, fields))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents WHERE length(text) BETWEEN 500 AND 9000 AND NOT list_has_any(regexp_split_to_array(text, '{_SPACE}'), ['sex', 'porn'])")
def streamed_to_file(spark, d):
    """Read from JSON lines, cleaned, written and read again."""
    source, target = (_scratch(spark, d, n) + ".jsonl" for n in ("source", "target"))
    corpus.copy_to(_docs(spark, d), source)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _docs(spark, d).schema)
    corpus.stream_to_file(spark, source, target, min_length=500, max_length=9000, schema=schema)
    return corpus.read_corpus(spark, target, "id string, text string").select("id", F.length("text").alias("n"))


@query("SELECT count(*) AS corrupt FROM (SELECT unnest(['{\"id\": 1', 'x', '[1']))")
def corrupt_lines(spark, d):
    path = _scratch(spark, d, "lines") + ".jsonl"
    lines = _docs(spark, d).select(F.to_json(F.struct(F.col("doc_id").alias("id"), "text")).alias("value"))
    lines.unionByName(spark.createDataFrame([('{"id": 1',), ("x",), ("[1",), ("",), (" ",)], "value string")).write.text(path)
    return corpus.corrupt_lines(spark, path, "id long, text string")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return ix.duplicate_ids(_read(spark, d, "conversations"), "conv_id").withColumnRenamed("id", "conv_id")


@query(_with(*_BASE, select="SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos, fp FROM post"))
def json_index(spark, d):
    path = _scratch(spark, d, "json")
    ix.write_json_index(_index(spark, d).postings, path, INDEX)
    return ix.read_json_index(spark, path)


@query(_with(*_BASE, select=f"SELECT CAST({INDEX.length} AS INTEGER) AS length, CAST({INDEX.window_size} AS INTEGER) AS window_size, CAST({INDEX.base} AS INTEGER) AS base, false AS punctuation, count(DISTINCT fp) AS num_fingerprints FROM post"))
def json_index_header(spark, d):
    path = _scratch(spark, d, "json")
    ix.write_json_index(_index(spark, d).postings, path, INDEX)
    return ix.read_json_header(spark, path)


@query(_with(*_BASE, select="SELECT doc_id, pos, fp FROM post"))
def merged_index(spark, d):
    """Two indexes in one folder, of halves of the documents, made one."""
    folder, out = _scratch(spark, d, "halves"), _scratch(spark, d, "merged")
    for k in (0, 1):
        half = _docs(spark, d).filter(F.pmod("doc_id", F.lit(2)) == k)
        ix.write_index(ix.build_postings(half, INDEX, "doc_id"), f"{folder}/{k}", INDEX)
    ix.merge_folder(spark, folder, out)
    return ix.read_index(spark, out).postings


@query(_with(*_BASE, select="SELECT fp, count(DISTINCT doc_id) AS df, count(*) AS n FROM post GROUP BY fp"))
def streamed_index(spark, d):
    """Documents that come as a stream, indexed batch by batch."""
    path = _scratch(spark, d, "streamed")
    # as a glob, as a source takes a folder or a glob, and the table may be a file or a folder of files
    rows = spark.readStream.schema(_docs(spark, d).schema).parquet(f"{d}/documents.parque[t]")
    index_stream(rows, path, f"{path}-checkpoint", INDEX, "doc_id", once=True).awaitTermination()
    ix.finish(spark, path, INDEX)
    return ix.read_index(spark, path).stats.select("fp", "df", "n")


_JAC = "hp AS (SELECT DISTINCT query_id, doc_id, 0 AS place, pos_query FROM pts)"
_BEST = "hp AS (SELECT DISTINCT query_id, doc_id, place, pos_query FROM cl JOIN ord USING (query_id, doc_id, cluster_id) WHERE place = 0)"
_SPANS = (_OFFSETS, _merged("hp.query_id, doc_id, place").replace("PARTITION BY hp.query_id", "PARTITION BY query_id"))
_SPAN_ROWS = 'SELECT query_id, doc_id, place, CAST(min(s) AS INTEGER) AS "start", CAST(max(e) AS INTEGER) AS "end" FROM isl GROUP BY query_id, doc_id, place, island'


@query(_with(*_PTS, _JAC, *_SPANS, select=_SPAN_ROWS))
def highlight_jaccard(spark, d):
    _, points = sc.chains(_q(spark, d), _index(spark, d))
    return hl.highlight(points, _items(spark, d), INDEX.length, "jaccard")


@query(_with(*_PTS, S.clusters(), _ORDER, _BEST, *_SPANS, select=_SPAN_ROWS))
def highlight_largest(spark, d):
    _, points = sc.chains(_q(spark, d), _index(spark, d))
    return hl.highlight(points, _items(spark, d), INDEX.length, "cc_largest")


@query(_with(S.tokens("xt", "benchmark", "item_id"), _OFFSETS, select='SELECT query_id AS item_id, pos, CAST(a AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end" FROM tk'))
def token_spans(spark, d):
    return fp.offset_rows(_read(spark, d, "benchmark"), "item_id")


_WEB_CAND = S.CANDIDATES.replace("rank <= 50", f"rank <= {WEB.top_k}")


@query(_with(*_BASE, _WEB_CAND, S.POINTS, S.clusters(offset=WEB.offset_threshold), S.CHAINS, select="SELECT query_id, doc_id, rank, raw_score FROM chain"))
def web_chain_scores(spark, d):
    """Chains with the preset of the web form."""
    return sc.score_chains(_q(spark, d), _index(spark, d), WEB)


@query(_with(*_PTS, S.clusters(), S.CHAINS, select=f"SELECT p.*, length(text) < {FRAGMENT} AS short_query, lang, source FROM ({_prob('SELECT * FROM chain')}) p JOIN (SELECT item_id AS query_id, text FROM benchmark) USING (query_id) LEFT JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)"))
def detect(spark, d):
    p = ScoreParams(min_fragment_length=FRAGMENT)
    out = sc.detect(_items(spark, d), _index(spark, d), p, metadata=_docs(spark, d).select("doc_id", "lang", "source"))
    return out.withColumn("raw_score", F.round("raw_score", 6)).withColumn("probability", F.round("probability", 6))


@query(_with(*_CAND, select="""SELECT '{"query_id":' || query_id || ',"doc_id":' || doc_id || ',"n_shared":' || n_shared || ',"rank":' || rank || '}' AS line FROM cand"""))
def ndjson_lines(spark, d):
    return sc.ndjson(cand.candidates(_q(spark, d), _index(spark, d).postings).select("query_id", "doc_id", "n_shared", "rank"))


_MARK = "concat('# ', lang, '  ', source, chr(10), 'part', chr(10), chr(10), '## Abstract', chr(10), chr(10), text)"


@query(
    r"""WITH l AS (SELECT doc_id, lang || ' ' || source || ' part' AS title, list_transform(regexp_split_to_array(text, '\r\n?|\n'), lambda x: regexp_replace(x, '^[ \t]+|[ \t]+$', '', 'g')) AS a FROM documents),
f AS (SELECT *, a[list_position(list_transform(a, lambda x: x <> ''), true):] AS r FROM l WHERE list_contains(list_transform(a, lambda x: x <> ''), true)),
e AS (SELECT *, coalesce(nullif(list_position(list_transform(r, lambda x: x = '' OR starts_with(x, '#')), true), 0) - 1, len(r)) AS k FROM f)
SELECT l.doc_id, l.title, nullif(trim(regexp_replace(array_to_string(e.r[1:e.k], ' '), '[ \t]+', ' ', 'g'))[1:1600], '') AS abstract FROM l LEFT JOIN e USING (doc_id)"""
)
def markdown_parts(spark, d):
    text = F.concat(F.lit("# "), F.col("lang"), F.lit("  "), F.col("source"), F.lit("\npart\n\n## Abstract\n\n"), F.col("text"))
    return _docs(spark, d).select("doc_id", text.alias("t")).select("doc_id", md.heading("t").alias("title"), md.abstract("t").alias("abstract"))


@query("SELECT p_partkey, 'https://en.wikipedia.org/wiki/' || replace(replace(p_name || ' & co (#' || p_partkey || ')', ' ', '_'), '#', '%23') AS wiki, 'https://example.org/part/' || p_partkey || '.html' AS page FROM part")
def page_links(spark, d):
    title = F.concat("p_name", F.lit(" & co (#"), F.col("p_partkey").cast("string"), F.lit(")"))
    return _read(spark, d, "part").select("p_partkey", md.wiki_url(title).alias("wiki"), md.doc_url("https://example.org/part/{doc_id}.html", "p_partkey").alias("page"))


@query(f"SELECT CAST(page_id AS VARCHAR) AS id, url AS u, {_HOST} AS host, 'https://web.archive.org/web/20240102030405/' || url AS link FROM pages WHERE url <> '' AND page_id IN (SELECT doc_id FROM labels)")
def sidecar(spark, d):
    """A side table of the pages that are labelled, built in two shards, merged and read."""
    pages = _read(spark, d, "pages").select("page_id", "url", F.lit("2024-01-02T03:04:05Z").alias("t"))
    only = _read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    base = _scratch(spark, d, "sidecar")
    shards = [f"{base}/{k}" for k in (0, 1)]
    for k, path in enumerate(shards):
        md.build_sidecar(pages.filter(F.pmod("page_id", F.lit(2)) == k), path, only, id_col="page_id", url_col="url", time_col="t")
    merged = md.merge_sidecars(spark, shards, f"{base}/all")
    corpus.write_sidecar(merged, f"{base}/json")
    return corpus.read_sidecar(spark, f"{base}/json", "id string, u string, host string, link string")


@query(r"SELECT item_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS place FROM (SELECT item_id, list_filter(regexp_extract_all(text, '[^.!?]*[.!?]+(?:\s+|$)|[^.!?]+$'), lambda x: trim(x) <> '') AS s FROM benchmark)")
def sentence_rows(spark, d):
    return _read(spark, d, "benchmark").select("item_id", F.posexplode(pt.sentences_column("text")).alias("place", "sentence"))


def _fold(mark: str, joined: str) -> str:
    return rf"""WITH RECURSIVE s AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '([{mark}]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: true) AS p FROM benchmark),
w AS (SELECT item_id, p, 0 AS i, CAST(NULL AS VARCHAR) AS now, CAST([] AS VARCHAR[]) AS done FROM s UNION ALL SELECT item_id, p, i + 1, {joined} FROM w WHERE i < len(p)),
r AS (SELECT item_id, list_append(done, now) AS c FROM w WHERE i = len(p))
SELECT item_id, unnest(c) AS chunk, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS place FROM r"""


@query(_fold(r".!?\n", "CASE WHEN now IS NULL THEN p[i + 1] WHEN length(now || ' ' || p[i + 1]) > 120 THEN p[i + 1] ELSE now || ' ' || p[i + 1] END, CASE WHEN length(now || ' ' || p[i + 1]) > 120 THEN list_append(done, trim(now)) ELSE done END"))
def chunk_rows(spark, d):
    """Chunks of up to 120 characters of the benchmark's texts."""
    return _read(spark, d, "benchmark").select("item_id", F.posexplode(pt.chunks_column("text", 120)).alias("place", "chunk"))


_GAP = "CASE WHEN c IN (' ', chr(9), chr(10), chr(13)) THEN 0.1 WHEN contains('-—–', c) THEN 0.2 WHEN contains('.,!?;:', c) THEN 0.3 WHEN contains('@#$%^&*()_+=/\\|<>', c) THEN 0.5 ELSE 1.0 END".replace("\\\\", "\\")
_SUB = "CASE WHEN a = b THEN 0.0 WHEN a = ' ' AND b = ' ' THEN 0.1 WHEN contains('-—–', a) AND contains('-—–', b) OR lower(a) = lower(b) THEN 0.2 WHEN contains('.,!?;:', a) AND contains('.,!?;:', b) THEN 0.3 WHEN contains('@#$%^&*()_+=/\\|<>', a) AND contains('@#$%^&*()_+=/\\|<>', b) THEN 0.5 ELSE 1.0 END".replace("\\\\", "\\")
#: The table of a pair's scores, a row of cells at a time: each from the row above and, along the row, from the cell before.
_DP = f"""WITH RECURSIVE names AS (SELECT 'n' || n_nationkey AS k, n_name || '.' AS t FROM nation UNION ALL SELECT 'r' || r_regionkey, lower(r_name) || ' -' FROM region),
ch AS (SELECT DISTINCT unnest(string_split(t, '')) AS c FROM names), gap AS (SELECT c, CAST({_GAP} AS FLOAT) AS g FROM ch),
sub AS (SELECT x.c AS a, y.c AS b, CAST({_SUB.replace(" a ", " x.c ").replace("(a)", "(x.c)").replace(", a)", ", x.c)").replace(" b ", " y.c ").replace("(b)", "(y.c)").replace(", b)", ", y.c)")} AS FLOAT) AS s FROM ch x, ch y),
pr AS (SELECT x.k AS k1, y.k AS k2, x.t AS s, y.t AS t FROM names x JOIN names y ON x.k <> y.k),
cell AS (SELECT k1, k2, s, t, 0 AS i, 0 AS j, CAST(0 AS FLOAT) AS h, list_transform(range(0, length(t) + 1), lambda q: CAST(0 AS FLOAT)) AS up, [CAST(0 AS FLOAT)] AS now, CAST(0 AS FLOAT) AS best, 0 AS bi, 0 AS bj FROM pr
 UNION ALL SELECT k1, k2, s, t, i2, j2, h2, CASE WHEN j2 = length(t) THEN list_append(now2, h2) ELSE up2 END, CASE WHEN j2 = length(t) THEN [CAST(0 AS FLOAT)] ELSE list_append(now2, h2) END,
  CASE WHEN h2 > best THEN h2 ELSE best END, CASE WHEN h2 > best THEN i2 ELSE bi END, CASE WHEN h2 > best THEN j2 ELSE bj END FROM (
  SELECT c.*, c.up AS up2, c.now AS now2, CASE WHEN j = length(t) OR i = 0 THEN i + 1 ELSE i END AS i2, CASE WHEN j = length(t) OR i = 0 THEN 1 ELSE j + 1 END AS j2,
   greatest(CAST(0 AS FLOAT), CASE WHEN s[i2] = t[j2] THEN up[j2] + CAST(1 AS FLOAT) ELSE up[j2] - sub.s2 END, up[j2 + 1] - g1.g, now[j2] - g2.g) AS h2
  FROM cell c JOIN (SELECT a, b, s AS s2 FROM sub) sub ON sub.a = s[CASE WHEN j = length(t) OR i = 0 THEN i + 1 ELSE i END] AND sub.b = t[CASE WHEN j = length(t) OR i = 0 THEN 1 ELSE j + 1 END]
  JOIN gap g1 ON g1.c = sub.a JOIN gap g2 ON g2.c = sub.b WHERE NOT (i = length(s) AND j = length(t))))
SELECT k1, k2, round(best, 4) AS score, CASE WHEN best > 0 THEN bi ELSE 0 END AS end1, CASE WHEN best > 0 THEN bj ELSE 0 END AS end2 FROM cell WHERE i = length(s) AND j = length(t)"""


@query(_DP)
def alignment_scores(spark, d):
    """The best local alignment of every two names: its score and where it ends."""
    n = _read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("k"), F.concat("n_name", F.lit(".")).alias("t"))
    n = n.unionByName(_read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("k"), F.concat(F.lower("r_name"), F.lit(" -")).alias("t")))
    x, y = n.toDF("k1", "text1"), n.toDF("k2", "text2")
    r = align.align_pairs(x.join(y, F.col("k1") != F.col("k2")), align.AlignParams(min_region=0)).withColumn("r", F.get("regions", F.lit(0)))
    return r.select("k1", "k2", F.round(F.coalesce("r.score", F.lit(0.0)), 4).alias("score"), F.coalesce("r.end1", F.lit(0)).alias("end1"), F.coalesce("r.end2", F.lit(0)).alias("end2"))
