"""The engine's queries as DuckDB SQL, to hold the Spark plans against."""

from __future__ import annotations

from passages.functions.fingerprint import FNV_PRIME, FNV_START
from passages.functions.unicode_classes import PUNCTUATION, SPACES
from passages.params import MODULUS, IndexParams

INDEX = IndexParams()


def tokens(name: str, source: str, id_col: str, text: str = "text", where: str = "true") -> str:
    return f"""{name} AS (SELECT {id_col}, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos FROM (
 SELECT {id_col}, list_filter(regexp_split_to_array(regexp_replace(coalesce({text}, ''), '{PUNCTUATION}', '', 'g'), '{SPACES}'), lambda x: x <> '') AS t FROM {source} WHERE {where}))"""


def hashes(name: str, *tables: str) -> str:
    """Distinct tokens of tables with their hashes; the bytes are folded in by recursion, all tokens at once."""
    union = " UNION ".join(f"SELECT token FROM {t}" for t in tables)
    return f"""{name}_v AS (SELECT DISTINCT token, hex(encode(token)) AS hx FROM ({union})),
{name}_r AS (SELECT token, hx, 0 AS i, CAST({FNV_START} AS UHUGEINT) AS h FROM {name}_v
 UNION ALL SELECT token, hx, i + 1, xor(h, CAST(('0x' || hx[2 * i + 1:2 * i + 2]) AS UHUGEINT)) * {FNV_PRIME} % 18446744073709551616 FROM {name}_r WHERE 2 * i < length(hx)),
{name} AS (SELECT token, CAST(h % {MODULUS} AS BIGINT) AS h FROM {name}_r WHERE 2 * i = length(hx))"""


def kgrams(name: str, toks: str, hash_table: str, id_col: str, p: IndexParams = INDEX) -> str:
    leads = ", ".join(f"lead(h, {j}) OVER w AS h{j}" for j in range(1, p.length))
    terms = " + ".join(f"{'h' if j == 0 else f'h{j}'} * {pow(p.base, p.length - j, MODULUS)} % {MODULUS}" for j in range(p.length))
    return f"""{name} AS (SELECT {id_col}, pos, ({terms}) % {MODULUS} AS fp FROM (SELECT {id_col}, pos, h, {leads} FROM {toks} JOIN {hash_table} USING (token) WINDOW w AS (PARTITION BY {id_col} ORDER BY pos)) WHERE h{p.length - 1} IS NOT NULL)"""


def winnow(name: str, grams: str, id_col: str, p: IndexParams = INDEX) -> str:
    return f"""{name} AS (SELECT DISTINCT {id_col}, CAST(-m.p AS INTEGER) AS pos, m.fp AS fp FROM (
 SELECT {id_col}, pos, min({{'fp': fp, 'p': -pos}}) OVER (PARTITION BY {id_col} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {p.window_size - 1} FOLLOWING) AS m, count(*) OVER (PARTITION BY {id_col}) AS n FROM {grams}) WHERE pos <= n - {p.window_size})"""


def index(queries: str = "benchmark", query_id: str = "item_id", query_text: str = "text", where: str = "true", source: str = "documents") -> str:
    """CTEs ``post`` (doc_id, pos, fp) and ``q`` (query_id, pos, fp)."""
    return ",\n".join(
        [
            tokens("dt", source, "doc_id"),
            tokens("qt", f"(SELECT {query_id} AS query_id, {query_text} AS text FROM {queries} WHERE {where})", "query_id"),
            hashes("th", "dt", "qt"),
            kgrams("dk", "dt", "th", "doc_id"),
            winnow("post", "dk", "doc_id"),
            kgrams("q", "qt", "th", "query_id"),
        ]
    )


CANDIDATES = """cand AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n_shared DESC, doc_id) AS INTEGER) AS rank FROM (
 SELECT query_id, doc_id, count(DISTINCT fp) AS n_shared FROM q JOIN post USING (fp) GROUP BY ALL) WHERE n_shared >= 5) WHERE rank <= 50)"""
RARITY = """nd AS (SELECT count(DISTINCT doc_id) AS nd FROM post),
rar AS (SELECT fp, 1 - count(DISTINCT doc_id) / any_value(nd) AS rarity, count(*) AS n FROM post, nd GROUP BY fp),
mean AS (SELECT 1 - avg(n) / any_value(nd) AS mean FROM rar, nd)"""
POINTS = """pts AS (SELECT query_id, doc_id, rank, q.fp AS fp, q.pos AS pos_query, post.pos AS pos_doc, post.pos - q.pos AS pos_offset FROM cand JOIN q USING (query_id) JOIN post USING (doc_id, fp))"""


def clusters(method: str = "rectangle", t: int = 30, least: int = 5, offset: int | None = None) -> str:
    near = {
        "rectangle": f"abs(a.pos_query - b.pos_query) <= {t} AND abs(a.pos_offset - b.pos_offset) <= {t if offset is None else offset}",
        "chebyshev": f"greatest(abs(a.pos_query - b.pos_query), abs(a.pos_offset - b.pos_offset)) <= {t}",
        "cityblock": f"abs(a.pos_query - b.pos_query) + abs(a.pos_offset - b.pos_offset) <= {t}",
        "euclidean": f"(a.pos_query - b.pos_query) * (a.pos_query - b.pos_query) + (a.pos_offset - b.pos_offset) * (a.pos_offset - b.pos_offset) <= {t * t}",
    }[method]
    return f"""pn AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos_query, pos_doc) AS i FROM pts),
ed AS (SELECT a.query_id, a.doc_id, a.i AS i, b.i AS j FROM pn a JOIN pn b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND {near}),
wk AS (SELECT query_id, doc_id, i, i AS j FROM pn UNION SELECT wk.query_id, wk.doc_id, wk.i, ed.j FROM wk JOIN ed ON ed.query_id = wk.query_id AND ed.doc_id = wk.doc_id AND ed.i = wk.j),
lb AS (SELECT query_id, doc_id, i, min(j) AS root FROM wk GROUP BY ALL),
sz AS (SELECT query_id, doc_id, root, CAST(dense_rank() OVER (PARTITION BY query_id, doc_id ORDER BY root) - 1 AS INTEGER) AS cluster_id FROM (SELECT query_id, doc_id, root FROM lb GROUP BY ALL HAVING count(*) >= {least})),
cl AS (SELECT pn.* EXCLUDE (i), coalesce(cluster_id, -1) AS cluster_id FROM pn JOIN lb USING (query_id, doc_id, i) LEFT JOIN sz USING (query_id, doc_id, root))"""


CHAINS = "chain AS (SELECT query_id, doc_id, rank, coalesce(max(s), 0) AS raw_score FROM cand LEFT JOIN (SELECT query_id, doc_id, cluster_id, CAST(count(DISTINCT fp) AS DOUBLE) AS s FROM cl WHERE cluster_id >= 0 GROUP BY ALL) USING (query_id, doc_id) GROUP BY ALL)"

