"""SQL for what SQL can express of the training-data operators: op2 and op4 in full, and the base columns of op1, op3, op8 and op9.

The base queries of queries.py are the operators' own ones without the columns
that the methods add, over the same whole tables.
"""

from __future__ import annotations

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _phrases() -> str:
    places = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        words = phrase.split()
        equal = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {equal}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    return f"list_concat(list_concat({places[0]}, {places[1]}), list_concat({places[2]}, {places[3]}))"


LICENSE = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, len(w) AS n_words, {_phrases()} AS places FROM words)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(list_transform(places, lambda p: p.at))::BIGINT AS first_word, list_max(list_transform(places, lambda p: p.at))::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels
FROM found"""


def _spans(kinds: list[tuple[str, str, str]]) -> str:
    """CTEs that end in spans(doc_id, base), base being a sorted list of structs; a kind is (name, pattern, condition on the match m)."""
    steps = ["raw AS (SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents)"]
    for n, (kind, pattern, condition) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        steps.append(f"parts_{kind} AS (SELECT r, string_split(regexp_replace(t, '{quoted}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM raw)")
        steps.append(f"ends_{kind} AS (SELECT r, unnest(p) AS m, unnest(range(1, len(p) + 1)) AS i FROM parts_{kind} WHERE len(p) > 1)")
        steps.append(f"at_{kind} AS (SELECT r, m, i, (sum(length(m)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS e FROM ends_{kind})")
        steps.append(f"hits_{kind} AS (SELECT r, {{'s': e - length(m), 'k': {n}, 'kind': '{kind}', 'e': e}} AS span FROM at_{kind} WHERE i % 2 = 0 AND ({condition}))")
    union = " UNION ALL ".join(f"SELECT * FROM hits_{kind}" for kind, _, _ in kinds)
    steps.append(f"hits AS ({union})")
    steps.append("spans AS (SELECT raw.doc_id, list_sort(coalesce(list(span) FILTER (span IS NOT NULL), [])) AS base FROM raw LEFT JOIN hits USING (r) GROUP BY raw.r, raw.doc_id)")
    return "WITH " + ",\n".join(steps)


def _digest(kinds: list[str]) -> str:
    counts = ", ".join(f"len(list_filter(base, lambda x: x.kind = '{k}'))::BIGINT AS n_{k}" for k in kinds)
    return f"SELECT doc_id, {counts}, sha256(array_to_string(list_transform(base, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')) AS base_sha256 FROM spans"


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN reverse({_DIGITS})[j]::INT ELSE 2 * reverse({_DIGITS})[j]::INT - CASE WHEN reverse({_DIGITS})[j]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_SMALL = "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"

PII = _spans([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _SMALL),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
]) + "\n" + _digest(["email", "ip", "card", "phone"])

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = _spans([
    ("assign", _ASSIGN, "length(regexp_extract(m, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", "[0-9a-f]+", "length(m) >= 32"),
]) + "\n" + _digest(["assign", "access", "hex"])

_BLANK = r"[^\x20\x09-\x0D]"
RULES = f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_BLANK}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_BLANK}')) AS lines FROM raw),
windows AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted"""

NEAR = r"""
WITH RECURSIVE raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
texts AS (SELECT row_number() OVER () AS n, t, min(doc_id) AS copy_id, count(*) AS n_copies, regexp_extract_all(lower(t), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw GROUP BY t),
grams AS (SELECT DISTINCT n, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g FROM (SELECT n, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT n, count(*) AS c FROM grams GROUP BY n),
shared AS (SELECT a.n AS a, b.n AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.n < b.n GROUP BY a.n, b.n),
linked AS (SELECT a, b FROM shared JOIN sizes x ON x.n = a JOIN sizes y ON y.n = b WHERE n_both >= 0.8 * (x.c + y.c - n_both) - 1e-9),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(n, m) AS (SELECT a, b FROM edges UNION SELECT reach.n, edges.b FROM reach JOIN edges ON reach.m = edges.a),
least AS (SELECT reach.n, min(texts.copy_id) AS low FROM reach JOIN texts ON texts.n = reach.m GROUP BY reach.n),
links AS (SELECT a AS n, count(*) AS n_links FROM edges GROUP BY a),
classes AS (SELECT t, w, least(copy_id, coalesce(low, copy_id)) AS class_id, copy_id, n_copies, coalesce(n_links, 0) AS n_links FROM texts LEFT JOIN least USING (n) LEFT JOIN links USING (n))
SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE class_id END AS class_id, CASE WHEN len(w) = 0 THEN doc_id ELSE copy_id END AS copy_id,
  CASE WHEN len(w) = 0 THEN 1 ELSE n_copies END::BIGINT AS n_copies, n_links::BIGINT AS n_links
FROM raw JOIN classes USING (t)"""

REPEATS = """
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, to_hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS w FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM raw WHERE length(h) >= 800)),
hits AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY w) AS c FROM starts) WHERE c > 1),
breaks AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM hits),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM breaks),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS low FROM spans),
cut AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' ORDER BY a) AS kept FROM gaps JOIN raw USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM raw LEFT JOIN cut USING (r)"""

def crc32(text: str) -> str:
    """crc32 of a short ASCII string, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, v: CASE WHEN xor(c, v) & 1 = 1 THEN xor(xor(c, v) >> 1, 3988292384) ELSE xor(c, v) >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), {step}), 4294967295)"


SNAPSHOTS = f"""
WITH old AS (SELECT doc_id, text, lang, source, {crc32("doc_id::VARCHAR")} % 10 AS m FROM documents),
moved AS (SELECT unnest(CASE WHEN m IN (3, 4) THEN [-1 - doc_id] WHEN m = 5 THEN [doc_id, -1 - doc_id] ELSE [doc_id] END) AS doc_id, text, lang, source, m FROM old WHERE m <> 0),
new AS (SELECT doc_id, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM moved),
gone AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS i FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.doc_id = o.doc_id)),
come AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS i FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.doc_id = n.doc_id)),
paired AS (
  SELECT n.doc_id AS key, o.doc_id AS old_key, concat_ws(',', CASE WHEN o.text IS DISTINCT FROM n.text THEN 'text' END, CASE WHEN o.lang IS DISTINCT FROM n.lang THEN 'lang' END, CASE WHEN o.source IS DISTINCT FROM n.source THEN 'source' END) AS changed, NULL AS op, n.text, n.lang, n.source
  FROM old o JOIN new n ON o.doc_id = n.doc_id
  UNION ALL
  SELECT coalesce(n.doc_id, o.doc_id), o.doc_id, '', CASE WHEN n.doc_id IS NULL THEN 'delete' WHEN o.doc_id IS NULL THEN 'insert' ELSE 'rekey' END, n.text, n.lang, n.source
  FROM gone o FULL JOIN come n ON o.text IS NOT DISTINCT FROM n.text AND o.lang IS NOT DISTINCT FROM n.lang AND o.source IS NOT DISTINCT FROM n.source AND o.i = n.i)
SELECT key, old_key, coalesce(op, CASE WHEN changed = '' THEN 'same' ELSE 'update' END) AS op, changed,
  CASE WHEN op IS DISTINCT FROM 'delete' THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256
FROM paired"""

def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _way(state: str, cost: str, letter: str, line: str, allowed: str = "true") -> str:
    """A step of the walk from a state: struct of cost, audit and text (each line after a line feed)."""
    return f"CASE WHEN {state} IS NOT NULL AND ({allowed}) THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


def _repair() -> str:
    line = "chr(10) || '{}:' || text"
    keep = lambda state, initial: _way(state, "p", "K", "chr(10) || role || ':' || text", f"f AND i0 = '{initial}'")
    role = lambda state, name: _way(state, "p + 3", "R", line.format(name), "f")
    more = lambda state, name: _way(state, "3", "I", f"chr(10) || '{name}:'")
    drop = lambda state: _way(state, "4", "D", "''")
    first = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    return rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS m FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE WHEN m = 1 THEN '' WHEN m = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE m <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_BLANK}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN regexp_extract(text, '({_BLANK})[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS i0, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS i1
  FROM placed),
turns AS (SELECT conv_id, i, role, text, i0, fault IN ('', 'truncated') AS f, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS p FROM marked),
counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i1 IS NOT NULL AND i0 || i1 NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {first} AS s0, CASE WHEN false THEN {first} END AS s1, {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}} AS s2, {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM counted
  UNION ALL
  SELECT conv_id, i, s0, s1, z2, {_least("n3", more("z2", "assistant"))} FROM (
    SELECT *, {_least("n2", more("s0", "user"), more("s1", "user"), more("n3", "user"))} AS z2 FROM (
      SELECT t.conv_id, t.i, {drop("w.s0")} AS s0, {_least(drop("w.s1"), keep("w.s0", "s"))} AS s1,
        {_least(drop("w.s2"), *[keep(x, "u") for x in ("w.s0", "w.s1", "w.s3")], *[role(x, "user") for x in ("w.s0", "w.s1", "w.s3")])} AS n2,
        {_least(drop("w.s3"), keep("w.s2", "a"), role("w.s2", "assistant"))} AS n3
      FROM walk w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1))),
ended AS (SELECT c.*, {_least("s0", "s3")} AS best FROM counted c JOIN walk w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""


LM = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({crc32("doc_id::VARCHAR")} % 7 = 2, false) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x20\\x09-\\x0D]+'), '') AS w FROM documents),
tokens AS (SELECT r, held_out, unnest(w) AS word FROM docs),
known AS (SELECT word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY word),
total AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM known),
found AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score FROM tokens LEFT JOIN known USING (word), total GROUP BY r)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, n AS train_tokens, base_score FROM docs JOIN found USING (r), total"""


ORACLES = {"op2_near_duplicates": NEAR, "op4_repeats": REPEATS, "base_op1_license": LICENSE, "base_op3_pii": PII, "base_op8_rules": RULES, "base_op9_secrets": SECRETS, "op11_conversation_repair": _repair(), "base_op12_lm": LM, "op13_snapshot_diff": SNAPSHOTS}
