"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_templates import BARE, LICENSE_WORDS, TEMPLATES, VARIANTS, VERSION, WINDOW
from .spotsigs import ANCHORS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w)),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM s) WHERE doc_id > first),
x AS (SELECT doc_id, w[i] AS word, i, c.i IS NOT NULL AS gone FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) LEFT JOIN c USING (doc_id, i)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM x GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

OP2 = f"""
WITH w AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, unnest([3, 5, 6, 7, 8, 9, 10]) t(n))),
c AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + n)) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, s) AS k FROM g) WHERE k >= CASE WHEN n > 5 THEN 3 ELSE 2 END),
r AS (SELECT doc_id, n, count(*) AS k, sum(len(w[i])) AS chars FROM c JOIN w USING (doc_id) GROUP BY ALL),
x AS (SELECT doc_id, max(k) FILTER (n = 3) AS k3, {", ".join(f"max(chars) FILTER (n = {n}) AS chars_{n}" for n in range(5, 11))} FROM r GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM w),
d AS (SELECT doc_id, sum(n - 1) AS n_dup, sum((n - 1) * chars) AS dup_chars FROM (
  SELECT doc_id, count(*) AS n, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l GROUP BY doc_id, line) WHERE chars > 0 GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: len(y))), 0)::BIGINT AS word_chars,
  len(coalesce(text, '')) - len(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(k3, 0)::BIGINT AS n_repeat_words,
  coalesce(dup_chars, 0)::DOUBLE / greatest(word_chars, 1) AS dup_line_share, {", ".join(f"coalesce(chars_{n}, 0)::DOUBLE / greatest(word_chars, 1) AS gram_share_{n}" for n in range(5, 11))}
  FROM w LEFT JOIN x USING (doc_id) LEFT JOIN d USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT (base_failed OR gram_share_5 > 0.30 OR gram_share_6 > 0.28 OR gram_share_7 > 0.26 OR gram_share_8 > 0.24 OR gram_share_9 > 0.22 OR gram_share_10 > 0.20 OR dup_line_share > 0.20) AS kept FROM f
"""

_STOPS = ", ".join(f"'{a}'" for a in dict.fromkeys(ANCHORS))
_MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _sigs(source: str) -> str:
    """Signatures of the texts (doc_id, text) in a named relation."""
    return f"""(SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [{_MD5.format("text")}] END AS s FROM (
      SELECT doc_id, text, list_sort(list_distinct(list_filter(list_transform(p, lambda x, i:
        CASE WHEN x - i + 1 < len(c) THEN {_MD5.format("w[x] || ' ' || c[x - i + 1] || ' ' || c[x - i + 2]")} END), lambda y: y IS NOT NULL))) AS s
      FROM (SELECT doc_id, text, w, list_filter(w, lambda y: y NOT IN ({_STOPS})) AS c, list_filter(range(1, len(w) + 1), lambda x: w[x] IN ({_STOPS})) AS p
        FROM (SELECT doc_id, text, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '.,;:!?"()[]', 'abcdefghijklmnopqrstuvwxyz' || repeat(' ', 16)), ' '), lambda y: y <> '') AS w FROM {source}))))"""


_JACCARD = "len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"
OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, len(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC) - 1 AS r, count(*) OVER () AS total FROM documents),
e AS (SELECT a.doc_id, b.doc_id AS next_id, left(a.text, a.n - a.n // 2) || left(b.text, a.n // 2) AS text FROM d a JOIN d b ON b.r = (a.r + 1) % a.total),
s AS (SELECT * FROM {_sigs("d")}), t AS (SELECT * FROM {_sigs("e")}),
f AS (SELECT doc_id, s.s AS a, t.s AS b, x.s AS c, text AS edited, next_id FROM s JOIN t USING (doc_id) JOIN e USING (doc_id) JOIN s x ON x.doc_id = e.next_id)
SELECT f.doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(list_transform(a, lambda x: printf('%08x', x)), '') AS fingerprint, array_to_string(list_transform(b, lambda x: printf('%08x', x)), '') AS edited_fingerprint,
  {_JACCARD.format("a", "b")} AS near_edited, {_JACCARD.format("a", "c")} AS near_next
FROM f JOIN d USING (doc_id)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d)),
m AS (SELECT doc_id, i, line, CASE WHEN len(list_filter(words, lambda t: NOT regexp_matches(t, '[0-9]') AND t <> '<*>')) >= 3 THEN list_transform(words, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) ELSE words END AS tokens FROM l),
k AS (SELECT DISTINCT doc_id, tokens, len(tokens) AS n, tokens[1:3] AS lead FROM m WHERE len(tokens) >= 3),
leaves AS (SELECT n, lead FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT n, lead, tokens, count(*) AS c, md5(array_to_string(tokens, ' ')) AS name FROM k JOIN leaves USING (n, lead) GROUP BY ALL),
p AS (SELECT *, n - 3 AS size, floor((n - 3) * (1 - 0.7::DOUBLE) + 1e-9::DOUBLE)::BIGINT + 1 AS pieces, tokens[4:] AS tail FROM v WHERE n > 3),
g AS (SELECT *, tail[i * size // pieces + 1:(i + 1) * size // pieces] AS piece FROM (SELECT *, unnest(range(0, pieces)) AS i FROM p)),
x AS (SELECT DISTINCT a.n, a.lead, a.tokens, a.tail, b.tokens AS other, {'c': b.c, 'name': b.name} AS rank FROM g a JOIN g b ON a.n = b.n AND a.lead = b.lead AND a.i = b.i AND a.piece = b.piece WHERE (b.c, b.name) > (a.c, a.name)),
y AS (SELECT *, list_filter(list_zip(tail, other[4:]), lambda z: NOT (z[1] = '<*>' AND z[2] = '<*>')) AS known FROM x),
taken AS (SELECT n, lead, tokens, arg_max(other, rank) AS template FROM y WHERE len(list_filter(known, lambda z: z[1] = z[2])) > 0 AND len(list_filter(known, lambda z: z[1] = z[2])) >= 0.7::DOUBLE * len(known) GROUP BY ALL),
t AS (SELECT n, lead, tokens, tokens AS template FROM v UNION ALL SELECT * FROM taken),
met AS (SELECT k.doc_id, k.tokens, k.n, k.lead, t.template FROM k JOIN t USING (n, lead, tokens)),
r AS (SELECT n, lead, template, min(doc_id) AS first FROM met GROUP BY n, lead, template HAVING count(DISTINCT doc_id) >= 3),
gone AS (SELECT DISTINCT doc_id, tokens FROM met JOIN r USING (n, lead, template) WHERE doc_id <> first),
o AS (SELECT m.doc_id, i, line, gone.tokens IS NULL AS stays FROM m LEFT JOIN gone ON m.doc_id = gone.doc_id AND m.tokens = gone.tokens)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM o GROUP BY doc_id
"""

_FORMS = ", ".join(f"('{name}', '{name}#{i}', '{text}')" for name, texts in TEMPLATES.items() for i, text in enumerate(texts))
_TERMS = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:\.[0-9]+)*')"
_NOTICES = ", ".join(f"array_to_string(lines[greatest(i - {back}, 1):greatest(i - {back}, 1) + {n - 1}], ' ')" for n in range(1, WINDOW + 1) for back in range(n))
_VERSIONS = f"list_filter(list_transform({_TERMS}, lambda t: regexp_extract(t, '{VERSION}', 1)), lambda v: v <> '')"
_NAMED = "CASE regexp_extract(t, '" + BARE + "', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VARIANTS.items()) + " END"
_VARIANTS = f"list_sort(list_distinct(list_filter(list_transform({_TERMS}, lambda t: {_NAMED}), lambda v: v IS NOT NULL)))"

OP8 = f"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(lower(lines[-1]), '{LICENSE_WORDS}') AND lang = 'en' THEN concat_ws('/', source, 'LICENSE-' || doc_id)
    WHEN regexp_matches(lower(lines[-1]), '{LICENSE_WORDS}') THEN concat_ws('/', source, lang, 'LICENSE-' || doc_id) ELSE concat_ws('/', source, lang, doc_id || '.txt') END AS path, lines
  FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
l AS (SELECT path, unnest(list_distinct(flatten(list_transform(list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lower(lines[i]), '{LICENSE_WORDS}')), lambda i: [{_NOTICES}])))) AS line FROM d),
u AS (SELECT line, count(*) AS n FROM l GROUP BY line),
c AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, unnest({_TERMS.format("line")}) AS term FROM u) GROUP BY ALL),
k AS (SELECT license, form, term, count(*) AS tf FROM (SELECT license, form, unnest({_TERMS.format("txt")}) AS term FROM (VALUES {_FORMS}) t(license, form, txt)) GROUP BY ALL),
f AS (SELECT term, ln(((SELECT sum(n) FROM u) + 1.0::DOUBLE) / (sum(df) + 1.0::DOUBLE)) + 1.0 AS idf FROM (SELECT term, n AS df FROM c UNION ALL SELECT term, 0 FROM k) GROUP BY term),
a AS (SELECT line, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY line)) AS w FROM c JOIN f USING (term)),
b AS (SELECT license, form, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license, form)) AS w FROM k JOIN f USING (term)),
q AS (SELECT line, license, form, round(sum(a.w * b.w), 6) AS score FROM a JOIN b USING (term) GROUP BY line, license, form HAVING score >= 0.6),
x AS (SELECT line, {_VERSIONS.format("line")} AS ver, {_VARIANTS.format("line")} AS var FROM u),
y AS (SELECT license, form, {_VERSIONS.format("txt")} AS ver, {_VARIANTS.format("txt")} AS var FROM (VALUES {_FORMS}) t(license, form, txt)),
s AS (SELECT line, license, score FROM q JOIN x USING (line) JOIN y USING (license, form) WHERE len(y.ver) = 0 OR list_has_any(x.ver, y.ver) AND x.var = y.var),
o AS (SELECT path, arg_min(license, (-score, license)) AS own_license, max(score) AS own_score FROM l JOIN s USING (line) GROUP BY path),
g AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, arg_min(own_license, (-own_score, own_license)) AS given FROM o WHERE regexp_matches(path, '(^|/)LICENSE-[^/]*$') GROUP BY folder),
p AS (SELECT path, string_split(path, '/') AS parts FROM d LEFT JOIN o USING (path) WHERE own_license IS NULL),
n AS (SELECT path, arg_max(folder, up) AS inherited_from, arg_max(given, up) AS given
  FROM (SELECT path, up, array_to_string(parts[1:up], '/') AS folder FROM (SELECT path, parts, unnest(range(0, len(parts))) AS up FROM p)) JOIN g USING (folder) GROUP BY path)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, given) AS license, inherited_from FROM d LEFT JOIN o USING (path) LEFT JOIN n USING (path)
"""

OP9 = f"""
WITH RECURSIVE walk AS (
  SELECT doc_id, (CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END)::UHUGEINT AS state, -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, s, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((s // 8589934592::UHUGEINT)::DOUBLE + 1)))::BIGINT
  FROM (SELECT doc_id, b, j, (state * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS s FROM walk WHERE j < 9)
), jumps AS (
  SELECT doc_id, max(b) FILTER (b < 8)::INT AS shard, max(b)::INT AS grown_shard FROM walk GROUP BY doc_id
), crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))
), sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM sized JOIN jumps USING (doc_id)
"""

OP10 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap AS clamped, sum(weight) OVER (ORDER BY cap / weight DESC, source DESC) AS w FROM c WHERE source_size > 0),
l AS (SELECT min(total - clamped) FILTER (false) AS x, arg_min((total - clamped) / w, cap / weight) FILTER ((total - clamped) / w < cap / weight) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, coalesce(level * weight, cap)) END::DOUBLE AS target FROM c, l),
r AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-12) ELSE 0 END AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)))"""
#: The CRC-32 of a whole number's decimal digits.
_CRC = "xor(list_reduce([4294967295] || list_transform(range(1, len({0}::VARCHAR) + 1), lambda i: ascii(({0}::VARCHAR)[i])::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"

OP11 = f"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
built AS (
  SELECT c.conv_id, 0 AS own, k, role, text FROM convs c JOIN turns b ON b.conv_id = c.base AND b.k <= c.h
  UNION ALL SELECT conv_id, 1, k, role, text FROM turns JOIN convs USING (conv_id) WHERE k > h),
seqs AS (SELECT conv_id, coalesce(list(sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) ORDER BY own, k) FILTER (k IS NOT NULL), []) AS s,
    coalesce(list(len(text) ORDER BY own, k) FILTER (k IS NOT NULL), []) AS sizes
  FROM convs LEFT JOIN built USING (conv_id) GROUP BY conv_id),
steps AS (SELECT conv_id, d, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, len(s) = d AS at_end, sha256(array_to_string(s[1:d], ',')) AS name, CASE WHEN d > 0 THEN sha256(array_to_string(s[1:d - 1], ',')) END AS above
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT d, name, above, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '') AS ends FROM steps GROUP BY d, name, above),
kids AS (SELECT d - 1 AS d, above AS name, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (d, name)),
sums AS (SELECT s.d, s.name, sum((o.n_children = 0)::BIGINT) AS n_leaves, sum((o.n_convs - 1) * o.size) AS saved FROM own o JOIN steps s ON s.conv_id = o.conv_id AND s.d <= o.d GROUP BY s.d, s.name)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN sums USING (d, name) LEFT JOIN nodes p ON p.d = o.d - 1 AND p.name = o.above
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
    CASE WHEN {_CRC.format("doc_id")} % 2 = 0 THEN sha256({_LEAF} || {_FIELD.format("replace(text, chr(10), '')")}) END AS changed FROM documents, crc_table),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS part, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
inner_tree AS (
  SELECT part, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY part) AS n FROM placed
  UNION ALL SELECT part, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), ((min(n) + 2) // 3)::BIGINT FROM inner_tree WHERE n > 1 GROUP BY part, level, pos // 3),
subroots AS (SELECT part, node AS subroot, level AS height FROM inner_tree WHERE n = 1),
outer_tree AS (
  SELECT 0 AS level, part AS pos, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), ((min(n) + 2) // 3)::BIGINT FROM outer_tree WHERE n > 1 GROUP BY level, pos // 3),
tree AS (
  SELECT part, level, pos, node FROM inner_tree WHERE n > 1
  UNION ALL SELECT s.part, height + level, pos, node FROM subroots s, outer_tree WHERE n > 1),
way AS (
  SELECT part, pos AS leaf_pos, 0 AS level, pos, coalesce(changed, leaf) AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT w.part, w.leaf_pos, w.level + 1, CASE WHEN w.level + 1 = min(height) THEN w.part ELSE w.pos // 3 END,
    sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.folded ELSE t.node END, '' ORDER BY t.pos)), w.proof || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> w.pos), '')
  FROM (SELECT way.part, leaf_pos, level, CASE WHEN height = 0 AND level = 0 THEN way.part ELSE pos END AS pos, folded, proof, height FROM way JOIN subroots USING (part)) w
  JOIN tree t ON t.part = w.part AND t.level = w.level AND t.pos // 3 = w.pos // 3 GROUP BY w.part, w.leaf_pos, w.level, w.pos, w.folded, w.proof),
done AS (SELECT part, leaf_pos AS pos, arg_max(folded, level) AS folded_root, arg_max(proof, level) AS proof FROM way GROUP BY part, leaf_pos),
root AS (SELECT node AS root FROM outer_tree WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN done USING (part, pos) JOIN subroots USING (part), root
"""

ORACLES = {"op8_license_templates": OP8, "op3_spot_signatures": OP3, "op1_block_anchors": OP1, "op7_line_templates": OP7, "op2_repetition_coverage": OP2, "op9_jump_sharding": OP9, "op10_water_filling": OP10, "op11_prefix_trie": OP11, "op12_merkle_exchange": OP12}
