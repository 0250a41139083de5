"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

SPLIT = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# --- op5 ----------------------------------------------------------------------------------------
_PHRASES = ("lorem ipsum|enable javascript|javascript is disabled|javascript is required|cookie policy|cookie settings|"
            "uses cookies|use cookies|accept all cookies|privacy policy|terms of use|terms of service|"
            "all rights reserved|copyright ©|click here|read more|sign in to|log in to|subscribe to|skip to content|"
            "skip to main content|follow us on|back to top|page not found")


def quality_ctes(src: str, cols: str) -> str:
    """CTE ``judged``: the rows of ``src`` with the figures, the cleaned text and ``kept``."""
    return rf"""
qd AS (SELECT row_number() OVER () AS rid, {cols}, coalesce(text, '') AS t FROM {src}),
qw AS (SELECT *, {SPLIT.format('t')} AS ws, string_split(t, chr(10)) AS ls FROM qd),
qg AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g
       FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM qw)),
qm AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM qg) WHERE n > 1),
qr AS (SELECT rid, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM (
         SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS c FROM qm) GROUP BY rid),
qc AS (SELECT *, array_to_string(list_filter(ls, lambda l: NOT (
         regexp_matches(l, '[^\x20\x09-\x0D]') AND (
           NOT regexp_matches(l, '[.!?:;…。！？]["''”’»)\]]*([\x20\x09-\x0D]|$)')
           OR (len(regexp_extract_all(l, '[#*$%&|<>!]')) > 2 AND
               len(regexp_extract_all(l, '[#*$%&|<>!]')) * 4 > len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')))
           OR len(regexp_extract_all(l, '[|•·»›→]')) >= 2
           OR regexp_matches(lower(l), '{_PHRASES}')))), chr(10)) AS clean FROM qw),
qf AS (SELECT qc.*, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(ws) - len({SPLIT.format('clean')}) AS BIGINT) AS lost_words
       FROM qc LEFT JOIN qr USING (rid)),
judged AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words * 100 <= n_words * 50 AS kept FROM qf)"""


OP5 = f"""WITH {quality_ctes('documents', 'doc_id')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept FROM judged"""


# --- op1 ----------------------------------------------------------------------------------------
def mixing_ctes(src: str) -> str:
    """CTE ``mixed``: the rows of ``src`` with size, source_size, target, copies."""
    return f"""
md AS (SELECT *, CAST(len({SPLIT.format("coalesce(text, '')")}) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 3) AS INT) AS b
       FROM {src}),
mh AS (SELECT source, b, sum(size) AS n FROM md GROUP BY source, b),
ms AS (SELECT source, CAST(sum(n) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM mh GROUP BY source),
mr AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k FROM ms),
ml AS (SELECT k, w, source_size,
         (sum(source_size) OVER () * 1.5 - coalesce(sum(2.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM mr),
mv AS (SELECT lev FROM ml WHERE lev * w <= 2.0 * source_size ORDER BY k LIMIT 1),
mt AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(2.0 * source_size, (SELECT lev FROM mv) * w) END AS target FROM ms),
mp AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM mt),
mc AS (SELECT source, b, n, sum(n) OVER (PARTITION BY source ORDER BY b) AS upto FROM mh),
mx AS (SELECT mc.source, max(b) AS top FROM mc JOIN mp ON mc.source IS NOT DISTINCT FROM mp.source
       WHERE upto * 2 - n < (target - whole * source_size) * 2 GROUP BY mc.source),
mixed AS (SELECT md.*, mp.source_size, mp.target, whole + CASE WHEN b <= coalesce(top, -1) THEN 1 ELSE 0 END AS copies
          FROM md JOIN mp ON md.source IS NOT DISTINCT FROM mp.source
          LEFT JOIN mx ON md.source IS NOT DISTINCT FROM mx.source)"""


OP1 = f"""WITH {mixing_ctes('documents')}
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * copies AS BIGINT) AS taken FROM mixed"""


# --- op3 ----------------------------------------------------------------------------------------
OP3 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, coalesce(url, '') AS u FROM pages),
o AS (SELECT *, CAST(strlen(h) AS BIGINT) AS n, count(*) OVER (PARTITION BY d) AS c,
        row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST, u) AS k,
        first_value(page_id) OVER (PARTITION BY d ORDER BY page_id NULLS LAST, u) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND k > 1 THEN f END AS refers_to FROM o"""


# --- op10 ---------------------------------------------------------------------------------------
def _host(u: str) -> str:
    return f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"


def _rule(h: str, p: str) -> str:
    def fits(host: str, path: str) -> str:
        return f"({h} = '{host}' OR ends_with({h}, '.{host}')) AND starts_with({p}, '{path}')"
    return f"""CASE WHEN {fits('www.example.com', '/en/')} THEN 'www.example.com/en/'
      WHEN {fits('example.com', '/en/')} THEN 'example.com/en/'
      WHEN {fits('net', '/es/')} THEN 'net/es/' WHEN {fits('net', '/fr/')} THEN 'net/fr/'
      WHEN {fits('com', '/')} THEN 'com/' END"""


def _node(u: str) -> str:
    rest = f"regexp_replace(regexp_replace({u}, '(?s)^.*?://[^/?#]*', ''), '(?s)#.*$', '')"
    rest = rf"regexp_replace({rest}, '(?i)([?&])(utm_[a-z]+|gclid|fbclid|mc_eid|ref)=[^&#]*', '\1', 'g')"
    rest = rf"regexp_replace(regexp_replace(regexp_replace({rest}, '([?&])&+', '\1', 'g'), '[?&]+$', ''), '/$', '')"
    host = f"regexp_replace({_host(u)}, ':(80|443)?$', '')"
    return f"CASE WHEN {host} <> '' THEN {host} || {rest} END"


_SAID = "CASE WHEN {0} IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN {0} IS NOT NULL THEN 'block' END"

def _unescape(e: str) -> str:
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#x2F;", "/"), ("&#47;", "/"), ("&amp;", "&")):
        e = f"replace({e}, '{entity}', '{ch}')"
    return e


OP10 = rf"""WITH RECURSIVE u0 AS (
  SELECT row_number() OVER () AS rid, page_id, url, {_host('url')} AS host, {_path('url')} AS path, {_node('url')} AS own,
    list_concat(
      list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                     lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                     lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1))) AS tags
  FROM pages),
u1 AS (SELECT *, {_rule('host', 'path')} AS rule FROM u0),
lk0 AS (SELECT rid, unnest(range(1, len(tags) + 1)) AS k, {_unescape('unnest(tags)')} AS t, coalesce(url, '') AS base,
          regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS s,
          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h,
          regexp_replace(path, '[^/]*$', '') AS f FROM u1),
lkp AS (SELECT *, CASE WHEN starts_with(t, '/') THEN '' WHEN f = '' THEN '/' ELSE f END || regexp_replace(t, '(?s)[?#].*$', '') AS p,
          regexp_extract(t, '(?s)[?#].*$') AS q FROM lk0),
lk1 AS (SELECT rid, k, CASE WHEN t = '' THEN '' WHEN starts_with(t, '//') THEN 'http:' || t
          WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN s = '' THEN ''
          WHEN left(t, 1) IN ('?', '#') THEN regexp_replace(base, '(?s)[?#].*$', '') || t
          ELSE s || '://' || h || '/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(p[2:], '/'), lambda g: [g])),
            lambda a, g: CASE g[1] WHEN '.' THEN a WHEN '..' THEN a[1:len(a) - 1] ELSE list_concat(a, g) END), '/') || q END AS x FROM lkp),
lk AS (SELECT rid, k, {_node('x')} AS other, {_host('x')} AS xh, {_path('x')} AS xp FROM lk1 WHERE {_node('x')} IS NOT NULL),
u2 AS (SELECT u1.*, coalesce(own, (SELECT arg_min(other, k) FROM lk WHERE lk.rid = u1.rid)) AS node FROM u1),
eg AS (SELECT DISTINCT node AS a, other AS b FROM u2 JOIN lk USING (rid) WHERE node <> other),
cl(a, b) AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg UNION
             SELECT cl.a, e.b FROM cl JOIN (SELECT a, b FROM eg UNION ALL SELECT b, a FROM eg) e ON cl.b = e.a),
roots AS (SELECT a, least(a, min(b)) AS root FROM cl GROUP BY a),
fa AS (SELECT own AS n, {_SAID.format('rule')} AS said FROM u1 WHERE own IS NOT NULL AND rule IS NOT NULL
       UNION ALL SELECT other, {_SAID.format('r')} FROM (SELECT other, {_rule('xh', 'xp')} AS r FROM lk) WHERE r IS NOT NULL),
fc AS (SELECT coalesce(root, n) AS c, bool_or(said = 'allow') AS allow, bool_or(said = 'block') AS block
       FROM fa LEFT JOIN roots ON n = a GROUP BY 1)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN {_SAID.format('rule')} WHEN allow THEN 'allow' WHEN block THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN allow OR block THEN 'alias' ELSE 'default' END AS reason
FROM u2 LEFT JOIN roots ON node = a LEFT JOIN fc ON coalesce(root, node) = c"""


# --- op11 ---------------------------------------------------------------------------------------
def _crc32(digits: str) -> str:
    """Unsigned CRC-32 (polynomial 0xEDB88320) of an ASCII string, bit by bit."""
    def shifted(x: str) -> str:
        return f"xor({x} >> 1, ({x} & 1) * 3988292384)"

    byte = "xor(a, b)"
    for k in range(8):
        byte = f"list_transform([{byte}], lambda x{k}: {shifted(f'x{k}')})[1]"
    ords = f"list_transform(string_split({digits}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {ords}), lambda a, b: {byte}), 4294967295)"


def _hashed(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _tree_ctes(name: str, src: str, levels: int) -> str:
    """Levels of the trees of ``src`` (tree, i, n, h): nodes ``{name}0..`` and runs ``{name}r0..``; a root stays as it is."""
    out = [f"{name}0 AS (SELECT tree, i, n, h FROM {src})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT tree, i // 8 AS r, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY tree, i // 8)")
        out.append(f"{name}{k + 1} AS (SELECT tree, r AS i, CASE WHEN n = 1 THEN 1 ELSE (n + 7) // 8 END AS n, "
                   f"CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")
    return ",\n".join(out)


def _path_ctes(name: str, runs: str, src: str, levels: int, tree: str, at: str) -> str:
    """Rows of ``src`` carried up the tree ``tree`` from place ``at``: the proof so far and the digest folded so far."""
    out = [f"{name}0 AS (SELECT * FROM {src})"]
    for k in range(levels):
        own = f"(({at} // {8 ** k}) % 8)"
        left = f"array_to_string(hs[1:{own}], '')"
        right = f"array_to_string(hs[{own} + 2:], '')"
        out.append(f"{name}{k + 1} AS (SELECT p.* EXCLUDE (proof, folded), "
                   f"CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof, "
                   f"CASE WHEN r.n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded "
                   f"FROM {name}{k} p JOIN {runs}r{k} r ON r.tree = {tree} AND r.r = {at} // {8 ** (k + 1)})")
    return ",\n".join(out)


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LEVELS, _TOP = 7, 3  # up to 8**7 documents of a language, 8**3 languages
_HEAD = " || ".join(_hashed(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
OP11 = f"""WITH md AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree,
  sha256({_HEAD} || {_hashed('text')}) AS leaf,
  CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0
       THEN sha256({_HEAD} || {_hashed(f"translate(text, '{_AZ}', '{_AZ.lower()}')")}) END AS tampered FROM documents),
ml AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY tree) AS n FROM md),
mb AS (SELECT tree, i, n, leaf AS h FROM ml),
{_tree_ctes('a', 'mb', _LEVELS)},
ms AS (SELECT tree AS lang_tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM a{_LEVELS}),
mt AS (SELECT '' AS tree, i, n, subroot AS h FROM ms),
{_tree_ctes('b', 'mt', _TOP)},
mp AS (SELECT ml.doc_id, ml.tree, ml.i, ml.leaf, ms.subroot, ms.i AS j, '' AS proof, coalesce(tampered, leaf) AS folded
       FROM ml JOIN ms ON ms.lang_tree = ml.tree),
{_path_ctes('c', 'a', 'mp', _LEVELS, 'p.tree', 'p.i')},
{_path_ctes('d', 'b', f'c{_LEVELS}', _TOP, "''", 'p.j')}
SELECT doc_id, leaf, subroot, (SELECT h FROM b{_TOP}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = (SELECT h FROM b{_TOP}) AS verified FROM d{_TOP}"""


# --- op12 ---------------------------------------------------------------------------------------
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(text, '{_AZ}', '{_AZ.lower()}'), '{_TERM}')"
OP12 = f"""WITH st AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
sd AS (SELECT *, CAST(len(ts) AS BIGINT) AS n FROM st WHERE len(ts) > 0),
sn AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sd),
si AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
sq AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT dense_rank() OVER (ORDER BY item_id) AS q, item_id, term FROM si) GROUP BY q, item_id, term),
sf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM sd) WHERE term IN (SELECT term FROM sq) GROUP BY rid, term),
sw AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
       FROM (SELECT term, count(*) AS df FROM sf GROUP BY term), sn),
sv AS (SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))) AS v
       FROM sf JOIN sw USING (term) JOIN sd USING (rid), sn),
ss AS (SELECT q, item_id, rid, CAST(sum(c * v) AS BIGINT) AS score FROM sq JOIN sv USING (term) GROUP BY q, item_id, rid),
sr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM ss JOIN sd USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM sr WHERE rank <= 20"""
