"""What SQL can state of the contract queries, in the oracle engine's words."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
_SPACED, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FITS = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))"
_RULES = [("example.com", "/en/7"), ("example.net", "/de/8"), ("com", "/en/"), ("net", "/de/"), ("org", "/es/")]
URL_RULES = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, '{_UP}', '{_LOW}') AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {_FITS.format(h, x)} THEN '{h}{x}'" for h, x in _RULES)} END AS rule,
  CASE WHEN {_FITS.format(*_RULES[0])} THEN 'allow' WHEN {_FITS.format(*_RULES[1])} OR {_FITS.format(*_RULES[2])} OR {_FITS.format(*_RULES[4])} THEN 'block' WHEN {_FITS.format(*_RULES[3])} THEN 'allow' END AS ruled FROM p
"""

LICENSE_BASE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d),
s AS (SELECT doc_id, i - 1 AS spot, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label FROM i),
g AS (SELECT doc_id, count(*) AS n, min(spot) AS a, max(spot) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM s WHERE label IS NOT NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""

#: The level is the one of the first source, by room per weight, that the rest does not fill.
MIX_TARGETS = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM d GROUP BY source),
o AS (SELECT *, 2.0 * source_size / weight AS bound, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM p),
v AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
l AS (SELECT min_by(level, k) AS level FROM v WHERE level <= bound)
SELECT d.doc_id, d.size, CAST(source_size AS BIGINT) AS source_size, round(least(2.0 * source_size, weight * l.level), 3) AS target FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, l
"""

QUALITY_COUNTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], chr(9)) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
h AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(h.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(h.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN l USING (doc_id) LEFT JOIN h USING (doc_id)
"""

#: Links by counting common shingles, groups by what is reachable.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i : i + 4], ' ') ELSE array_to_string(w, ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT DISTINCT x AS doc_id, x AS there FROM b UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.there = b.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(there) AS low FROM r GROUP BY 1) m USING (doc_id)
"""

#: Words are split by the contract's class after lower-casing A-Z only; a document word is hit where
#: the ten (or the item's fewer) words from some place equal a window's.
OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win
), place AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n)
), hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON p.n = win.n AND p.s = win.s
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The tables' pages have one plain article element of headings and paragraphs each.
PAGE_TEXT = r"""
WITH b AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS b FROM pages),
d AS (SELECT page_id, url, list_transform(b, lambda x: replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS b FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

FILL_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h4 FROM d),
c AS (SELECT *, least(h4[1] % (n + 1), h4[2] % (n + 1)) AS a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h4[3] % 100 >= 90 THEN 'plain' WHEN h4[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""


def _turn_repair() -> str:
    """States 0 to 3 are start, after system, user and assistant; each holds the best (cost, audit, repaired text) so far."""
    crc = "xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295), 4294967295)"
    user_line, assistant_line = "'user:'", "'assistant:'"
    none = "{'c': 1000000000, 'a': '', 't': ''}"

    def more(state: str, cost: str, edit: str, line: str = "") -> str:
        text = f"{state}.t" + (f" || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}" if line else "")
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {text}}}"

    def inserted(f: list[str]) -> list[str]:
        """One insert at most into each state; a second one ('II' to the assistant's) from what the first gave."""
        user = f"least({f[2]}, {', '.join(more(f[k], '5', 'I', user_line) for k in (0, 1, 3))})"
        twice = ", ".join(more(f"({more(f[k], '5', 'I', user_line)})", "5", "I", assistant_line) for k in (0, 1))
        assistant = f"least({f[3]}, {more(f[2], '5', 'I', assistant_line)}, {twice})"
        return [f[0], f[1], user, assistant]

    old = [f"s[{i}]" for i in (1, 2, 3, 4)]
    opened = "[" + ", ".join(inserted(old)) + "]"
    line = "(x.role || ':' || x.text)"
    gone = [more(f"s[{i}]", "2", "D") for i in (1, 2, 3, 4)]

    def arrive(i: int, initial: str | None, name: str | None, before: tuple[int, ...]) -> str:
        found = [gone[i]]
        for b in before:
            f = f"s[{b + 1}]"
            kept = f"CASE WHEN x.gone OR x.role[1] <> '{initial}' THEN {none} ELSE {more(f, 'x.extra', 'K', line)} END"
            found.append(kept)
            if name:
                found.append(f"CASE WHEN x.gone THEN {none} ELSE {more(f, 'x.extra + 1', 'R', f"('{name}:' || x.text)")} END")
        return f"least({', '.join(found)})"

    step = "[" + ", ".join([gone[0], arrive(1, "s", None, (0,)), arrive(2, "u", "user", (0, 1, 3)), arrive(3, "a", "assistant", (2,))]) + "]"
    return f"""
WITH k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CAST({crc} % 20 AS INTEGER) AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS r FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY r) AS before FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'role': role, 'text': text, 'gone': fault IN ('blank', 'duplicate'), 'extra': CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END}} ORDER BY r) AS rows FROM f GROUP BY conv_id),
e AS (SELECT *, list_reduce(rows, lambda q, x: list_transform([{opened.replace('s[', 'q[')}], lambda s: {step})[1], [{{'c': 0, 'a': '', 't': ''}}, {none}, {none}, {none}]) AS s FROM g),
b AS (SELECT *, least(s[1], {inserted(old)[3]}) AS best FROM e)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


TURN_REPAIR = _turn_repair()
