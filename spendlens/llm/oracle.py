"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: CRC-32 (reflected polynomial 0xEDB88320): the table by its rule, and of a text's UTF-8 bytes.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
  CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS crc_table)"""


def _crc32(text: str) -> str:
    byte = f"(16 * (instr('0123456789ABCDEF', substr(hex(encode({text})), i, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode({text})), i + 1, 1)) - 1)"
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: {byte}::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a // 256, crc_table[xor(a % 256, b) + 1]), 4294967295::BIGINT), 4294967295)"


# ------------------------------------------------------------ op11
_ROUNDS = 20
_FITS = {
    "net/": "((host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/'))",
    "example.net/en/": "((host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/'))",
    "example.com/de/": "((host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/'))",
    "org/fr/": "((host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/'))",
}
_RULE = "CASE " + " ".join(f"WHEN {_FITS[r]} THEN '{r}'" for r in sorted(_FITS, key=len, reverse=True)) + " END"
_VERDICT = "CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' END"


def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_HREF = r"""(?i)\shref\s*=\s*["'']?\s*([^"''\s>]*)"""
_REL = r"""(?i)\srel\s*=\s*["'']?[^"''>]*\b(?:nofollow|ugc|sponsored)\b"""


def _target(tag: str, at: str) -> str:
    href = f"regexp_extract({tag}, '{_HREF}', 1)"
    return f"""CASE WHEN regexp_matches({href}, '^(?i)https?://') THEN {_host(href)}
 WHEN starts_with({href}, '//') THEN {_host(f"concat('x:', {href})")}
 WHEN NOT regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') AND regexp_matches({tag}, '{_HREF}') THEN {at} END"""


def _url_filters() -> str:
    parts = [f"""p AS (SELECT page_id, url, html, coalesce({_host("url")}, '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)""",
        f"q AS (SELECT *, {_RULE} AS rule FROM p)",
        f"r AS (SELECT *, {_VERDICT} AS ruled FROM q)",
        f"""tags AS (SELECT row_number() OVER () AS page, host, regexp_extract(html, '(?i)<base\\s[^<>]*>', 0) AS base,
  list_filter(regexp_extract_all(html, '(?i)<(?:a|area)\\s[^<>]*>', 0), lambda t: NOT regexp_matches(t, '{_REL}')) AS tags FROM p WHERE host <> '')""",
        f"based AS (SELECT page, host, coalesce(CASE WHEN base <> '' THEN {_target('base', 'host')} END, host) AS home, unnest(tags) AS tag FROM tags)",
        f"linked AS (SELECT DISTINCT page, host AS src, {_target('tag', 'home')} AS dst FROM based)",
        "n AS (SELECT src, dst, count(*) AS n FROM linked WHERE dst IS NOT NULL AND dst <> '' AND dst <> src GROUP BY src, dst)",
        "edges AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM n)",
        """own AS (SELECT host, path, ruled FROM r WHERE host <> ''
  UNION ALL SELECT * FROM (SELECT DISTINCT dst, '/', NULL FROM edges) WHERE dst NOT IN (SELECT host FROM r))""".replace("'/', NULL", "'/' AS path, '' AS ruled"),
        f"""known AS MATERIALIZED (SELECT host, avg((coalesce(v, '') = 'allow')::INT::DOUBLE) AS trusted, avg((coalesce(v, '') = 'block')::INT::DOUBLE) AS blocked
  FROM (SELECT host, {_VERDICT} AS v FROM (SELECT host, path, {_RULE} AS rule FROM own)) GROUP BY host)""",
        "s0 AS (SELECT host, trusted AS trust, blocked AS distrust FROM known)"]
    for i in range(1, _ROUNDS + 1):
        parts.append(f"""s{i} AS MATERIALIZED (SELECT k.host, trusted + 0.85 * coalesce(f.gets, 0) AS trust, blocked + (1 - blocked) * 0.85 * coalesce(b.leads, 0) AS distrust FROM known k
  LEFT JOIN (SELECT dst, sum(weight * trust) AS gets FROM edges JOIN s{i - 1} ON host = src GROUP BY dst) f ON f.dst = k.host
  LEFT JOIN (SELECT src, sum(weight * distrust) AS leads FROM edges JOIN s{i - 1} ON host = dst GROUP BY src) b ON b.src = k.host)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN distrust - trust > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN s{_ROUNDS} s ON s.host = r.host"""


# ------------------------------------------------------------ op12
def _resampling() -> str:
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS words FROM documents),
dw AS (SELECT k, unnest(words) AS w FROM d),
tw AS (SELECT unnest({words}) AS w FROM benchmark),
v AS (SELECT w, {_crc32("w")} % 10000 AS b FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM tw)), crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN v USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM tw JOIN v USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS alls, (SELECT count(*) FROM tw)::DOUBLE AS allt),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (alls + 10000) / ((s + 1.0::DOUBLE) * (allt + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b), n),
w AS (SELECT k, sum(g)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY k),
f AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (k)),
sc AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM f),
a AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS r FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM sc WHERE n_features >= 20) THEN r END::BIGINT AS rank FROM a"""


# ------------------------------------------------------------ op13
#: Levels that the SQL unrolls: 8 to this power rows of a language, or languages, at most.
_DEPTH = 7


def _value(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"


def _tree(name: str, at: str, first: str) -> list[str]:
    """CTEs ``name``0 to ``name``DEPTH: nodes (t, pos, h) by level; a lone node stays as it is."""
    out = [f"{name}0 AS MATERIALIZED ({first})"]
    for i in range(_DEPTH):
        out.append(f"""{name}{i}r AS MATERIALIZED (SELECT t, pos // 8 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {name}{i}) GROUP BY t, pos // 8)""")
        out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT t, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}{i}r)")
    return out


def _climb(name: str, tree: str, key: str, pos: str, start: str) -> list[str]:
    """CTEs ``name``0 to ``name``DEPTH: rows with their proof and folded digest by level."""
    out = [f"{name}0 AS (SELECT *, {pos} AS p FROM {start})"]
    for i in range(_DEPTH):
        left, right = "array_to_string(hs[:p % 8], '')", "array_to_string(hs[p % 8 + 2:], '')"
        out.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (p, proof, fold), a.p // 8 AS p,
  CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
  CASE WHEN n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold
  FROM {name}{i} a JOIN {tree}{i}r r ON r.t = a.{key} AND r.run = a.p // 8)""")
    return out


def _manifest() -> str:
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaf = "sha256(concat(" + ", ".join(map(_value, [*fields, "text"])) + "))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tampered = "sha256(concat(" + ", ".join(map(_value, [*fields, low])) + "))"
    parts = [_CRC_TABLE,
        "g AS (SELECT lang AS gl, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT lang FROM documents))",
        f"l AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {tampered} ELSE {leaf} END AS fold FROM documents, crc)",
        "d AS MATERIALIZED (SELECT l.*, t, 0 AS top, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, '' AS proof FROM l JOIN g ON lang IS NOT DISTINCT FROM gl)",
        *_tree("a", "t", "SELECT t, pos, leaf AS h FROM d"),
        *_tree("b", "t", f"SELECT 0 AS t, t AS pos, h FROM a{_DEPTH}"),
        *_climb("x", "a", "t", "pos", "d"), *_climb("y", "b", "top", "t", f"(SELECT * EXCLUDE (p) FROM x{_DEPTH})")]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, a.h AS subroot, b.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b.h AS verified
FROM y{_DEPTH} y JOIN a{_DEPTH} a ON a.t = y.t, b{_DEPTH} b"""


ORACLE_SQL: dict[str, str] = {
    "op11_url_filters": _url_filters(),
    "op12_resampling": _resampling(),
    "op13_merkle_manifest": _manifest(),
}
