"""DuckDB SQL with the same rows as those queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def chat(control: str) -> str:
    return rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{control}' UNION ALL SELECT -1, 1, 'assistant', '{control}'),
    e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS n FROM t),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


LAYOUTS = """WITH t AS (SELECT conv_id, turn, CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(role, '') END AS role, coalesce(text, '') AS text FROM conversations),
    g AS (SELECT conv_id, count(*) AS n_turns, list(role ORDER BY turn, role, text) AS roles, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said FROM t GROUP BY conv_id)
    SELECT conv_id, CASE WHEN roles = ['user', 'assistant'] AND conv_id % 3 = 0 THEN 'prompt_completion' WHEN roles = ['user', 'assistant'] AND conv_id % 3 = 1 THEN 'instruction' WHEN conv_id % 3 = 1 THEN 'conversations' ELSE 'messages' END AS layout,
    NULL AS error, n_turns, sha256(said) AS turns_sha256 FROM g"""


def sharding(shards: int, slots: int) -> str:
    drawn = "('0x' || left(md5('shard-' || lpad(i::VARCHAR, 2, '0') || ':{}'), 15))::BIGINT"
    return f"""WITH RECURSIVE p AS (SELECT list({drawn.format('offset')} % {slots} ORDER BY i) AS o, list({drawn.format('skip')} % {slots - 1} + 1 ORDER BY i) AS k FROM range({shards}) r(i)),
    fill(step, owner, tried) AS (SELECT 0, list_transform(range({slots}), lambda x: -1), list_transform(range({shards}), lambda x: 0) UNION ALL
      SELECT step + 1, list_concat(list_append(owner[1:spot], who), owner[spot + 2:{slots}]), list_concat(list_append(tried[1:who], j + 1), tried[who + 2:{shards}])
      FROM (SELECT *, (o[who + 1] + j * k[who + 1]) % {slots} AS spot FROM (SELECT fill.*, o, k, step % {shards} AS who,
        list_filter(range(tried[step % {shards} + 1], {slots}), lambda x: owner[(o[step % {shards} + 1] + x * k[step % {shards} + 1]) % {slots} + 1] = -1)[1] AS j FROM fill, p WHERE step < {slots}))),
    t AS (SELECT owner FROM fill WHERE step = {slots}), d AS (SELECT doc_id, (('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT % {slots})::INT AS slot FROM documents)
    SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1]::VARCHAR, 2, '0') AS shard FROM d, t"""


LINES = """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
  w AS (SELECT doc_id, pos, array_to_string(l[pos + 1:pos + 3], chr(10)) AS k FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM l WHERE len(l) >= 3) WHERE trim(l[pos + 1] || l[pos + 2] || l[pos + 3]) <> ''),
  f AS (SELECT k, min((doc_id, pos)) AS f FROM w GROUP BY k HAVING count(*) > 1),
  c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + 3)) AS p FROM w JOIN f USING (k) WHERE (doc_id, pos) <> f.f) GROUP BY doc_id)
  SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed FROM l LEFT JOIN c USING (doc_id)"""


def hosts(rules: list[tuple[str, str, str]], suffixes: tuple[str, ...], z: float = 1.645, limit: float = 0.25) -> str:
    listed = ", ".join(f"'{x}'" for x in suffixes)
    fits = [(h + p, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, _, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for _, v, c in fits) + " END"

    def level(name: str, key: str, counts: str, parent: str | None, above: str | None) -> str:
        based = f"SELECT c.*, p.a / (p.a + p.b) AS m FROM {counts} c JOIN {above} p USING ({parent})" if parent else f"SELECT c.*, (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 1)::DOUBLE / (sum(n) + 2) ELSE 0 END FROM {counts}) AS m FROM {counts} c"
        return f"""{name}_m AS ({based}), {name}_s AS (SELECT sum(m * (1 - m)) AS v0, sum(n * m * (1 - m)) AS v1, sum(n * (bad::DOUBLE / n - m) ^ 2) AS s, count(*) AS k FROM {name}_m WHERE n > 0),
        {name}_k AS (SELECT least(greatest(1 / greatest(CASE WHEN k > 1 AND v1 > v0 THEN (s - v0) / (v1 - v0) ELSE 0 END, 1e-3) - 1, 1), 999) AS k FROM {name}_s),
        {name} AS (SELECT t.*, m * q.k + bad AS a, (1 - m) * q.k + n - bad AS b FROM {name}_m t, {name}_k q)"""

    return rf"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, {_FOLD.format("regexp_extract(rest, '^([^/?#]*)', 1, 's')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
    o AS (SELECT doc_id AS page_id, 1 - max(quality) AS bad FROM labels GROUP BY doc_id),
    hc AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
    hb AS (SELECT *, string_split(bare, '.') AS labels, regexp_matches(bare, '^[0-9.]+$|^\[') AS address, array_to_string(string_split(bare, '.')[-2:], '.') AS two FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', '', 's'), '(:[0-9]*)?\.?$', '') AS bare FROM hc)),
    h AS (SELECT host, n, bad, CASE WHEN address THEN bare WHEN two IN ({listed}) THEN array_to_string(labels[-3:], '.') ELSE two END AS domain, CASE WHEN address THEN bare WHEN two IN ({listed}) THEN two ELSE labels[-1] END AS suffix FROM hb),
    dc AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL), sc AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dc GROUP BY ALL),
    {level("fs", "suffix", "sc", None, None)}, {level("fd", "domain", "dc", "suffix", "fs")}, hx AS (SELECT host, domain, n, bad FROM h), {level("fh", "host", "hx", "domain", "fd")},
    r AS (SELECT host, greatest(0, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS low FROM fh)
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN low > {limit} THEN 'block' ELSE 'allow' END) AS verdict FROM p JOIN r USING (host)"""


def contamination(window: int = 10) -> str:
    words = rf"regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
    x AS (SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[spot + 1:spot + least(len(w), {window})], ' ') AS k FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - {window - 1}))) AS spot FROM i WHERE len(w) > 0)),
    d AS (SELECT doc_id, {words} AS w FROM documents), n AS (SELECT DISTINCT n FROM x),
    o AS (SELECT doc_id, spot, n, array_to_string(w[spot + 1:spot + n], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS spot FROM d, n WHERE len(w) >= n)),
    h AS (SELECT doc_id, spot, n, item_id FROM o JOIN x USING (n, k)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS p FROM h) GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""
