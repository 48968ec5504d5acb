"""DuckDB oracles of the opN queries that SQL can express.

The others are held against brute force in the tests: they need the library's
tokenizers, XXH64 or a fitted model.
"""

from __future__ import annotations

from silt.llm import pii
from silt.llm.queries import URL_RULES

# Each base or own kind: its expression as RE2 takes it, what confirms a match x, its score, context words, whether it is a base kind.
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[length({_DIGITS}) + 1 - i]::INT WHEN {_DIGITS}[length({_DIGITS}) + 1 - i]::INT > 4 THEN 2 * {_DIGITS}[length({_DIGITS}) + 1 - i]::INT - 9 ELSE 2 * {_DIGITS}[length({_DIGITS}) + 1 - i]::INT END)) % 10 = 0"
_FLAT = "replace(x, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split(substr({_FLAT}, 5) || left({_FLAT}, 4), ''), lambda c: (CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)::BIGINT)), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1"
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|contact|write", True),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(x, '.'), lambda p: NOT (regexp_full_match(p, '0*[0-9]{1,3}') AND right(p, 3)::INT <= 255))) = 0", 0.6, "ip|host|server|address|from", True),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", 0.8, "card|visa|credit|pay", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.7, "phone|tel|call|mobile|fax", True),
    ("iban", rf"\b{pii.IBAN}\b", _MOD97, 0.9, "iban|account|bank", False),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(x, '^(000|666|9..)-|-00-|-0000$')", 0.3, "ssn|social|security|tax", False),
    ("secret", r"\b(?i:token|secret|password|api[_-]?key)[\x22\x27]?\x20?[:=]\x20?[\x22\x27]?[A-Za-z0-9_/+.-]{16,}", "true", 0.6, "access|auth|login|key", False),
]


def _pii() -> str:
    parts, kinds = [], []
    for kind, pattern, confirm, score, words, base in _KINDS:
        parts.append(f"regexp_extract_all(t, '{pattern}') AS m_{kind}, string_split_regex(t, '{pattern}') AS g_{kind}")
        at = f"list_transform(range(1, len(m_{kind}) + 1), lambda i: {{'s': (list_sum(list_transform(g_{kind}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m_{kind}[1:i - 1], lambda y: length(y))), 0))::BIGINT, 'x': m_{kind}[i]}})"
        kept = f"list_filter({at}, lambda r: list_transform([r.x], lambda x: {confirm})[1])"
        if not base:
            near = "lower(substr(t, greatest(r.s - 40, 0) + 1, r.s - greatest(r.s - 40, 0)) || ' ' || substr(t, r.s + length(r.x) + 1, 40))"
            kept = f"list_filter({kept}, lambda r: {score} + CASE WHEN regexp_matches({near}, '\\b({words})') THEN 0.35 ELSE 0 END >= 0.5)"
        kinds.append((kind, base, f"list_transform({kept}, lambda r: '{kind}:' || r.s || ':' || (r.s + length(r.x)))"))
    spans = ", ".join(f"{sql} AS s_{kind}" for kind, _, sql in kinds)
    base = " || ".join(f"s_{k}" for k, b, _ in kinds if b)
    every = " || ".join(f"s_{k}" for k, _, _ in kinds)
    counts = ", ".join(f"len(s_{k})::BIGINT AS n_{k}" for k, b, _ in kinds if b)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, t, {', '.join(parts)} FROM d), s AS (SELECT doc_id, {spans} FROM f) SELECT doc_id, {counts}, sha256(array_to_string({base}, ',')) AS base_sha256, array_to_string({every}, ',') AS spans FROM s"


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_URLS = f"""WITH r(verdict, h, p) AS (VALUES {_RULES}),
 a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
 f AS (SELECT b.page_id, b.host, b.path, r.h || r.p AS rule, r.verdict, length(r.h) + length(r.p) AS n FROM b LEFT JOIN r ON (b.host = r.h OR ends_with(b.host, '.' || r.h)) AND starts_with(b.path, r.p))
 SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST) = 1"""

_TOP = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

_LINKS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
 c AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.reached),
 m AS (SELECT node, min(reached) AS component_id FROM c GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
 SELECT node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, node = component_id AS kept FROM m LEFT JOIN n ON n.a = m.node"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DEDUP = f"""WITH l AS (SELECT doc_id, i, list_extract(parts, i) AS line, translate(trim(list_extract(parts, i), {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
 o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
 f AS (SELECT l.doc_id, l.i, l.line, coalesce(o.owner <> l.doc_id, false) AS gone FROM l LEFT JOIN o ON o.k = l.k)
 SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id"""

# crc32 byte by byte: the table of the 256 remainders, then one step a character of the digits and commas
_BAND = """WITH t AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r FROM range(256) AS x(b))),
 c AS (SELECT sale_id, line_no, item_id, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS a, concat(sale_id, ',', line_no, ',', item_id) AS s FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity > 0 AND amount IS NOT NULL),
 l AS MATERIALIZED (SELECT sale_id, line_no::BIGINT AS line_no, item_id AS line_item_id, (2 * a + q - ((2 * a + q) % (2 * q) + 2 * q) % (2 * q)) // (2 * q) AS u, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda h, b: xor(h >> 8, t.t[(xor(h, b) & 255) + 1])), 4294967295) AS crc FROM c, t),
 i AS (SELECT row_number() OVER () AS r, item_id, floor(100 * price + 0.5)::BIGINT AS p FROM items),
 p AS (SELECT r, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc FROM i JOIN l ON u BETWEEN p - greatest(10, 2 * p // 1000) AND p + greatest(10, 2 * p // 1000) AND line_item_id <> item_id),
 s AS (SELECT r, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM p GROUP BY r),
 b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS k FROM p QUALIFY k <= 5)
 SELECT item_id, coalesce(k, 0)::INT AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0)::BIGINT AS n_pairs, coalesce(gap_sum, 0)::BIGINT AS gap_sum, coalesce(lines_crc, 0)::BIGINT AS lines_crc FROM i LEFT JOIN s ON s.r = i.r LEFT JOIN b ON b.r = i.r"""

ORACLE: dict[str, str] = {
    "op1_pii": _pii(),
    "op5_embedding_dedup": _LINKS,
    "op6_topk": _TOP,
    "op8_urls": _URLS,
    "op11_line_dedup": _DEDUP,
    "op12_price_band": _BAND,
}
