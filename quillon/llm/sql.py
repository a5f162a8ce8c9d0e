"""The same results as SQL for DuckDB, by other ways: brute force over words, windows and pairs.

p7_ids and p9 are not here: token ids are compared with the tokenizers library in the tests, and the robust fit is no SQL. p2 has the same rules for whole values, but no pigeonhole join under them.
"""

from __future__ import annotations

from quillon.llm.canonical import ACCENTED, PLAIN, SHARED, Conventions
from quillon.llm.codepoints import INVISIBLE, LOOKALIKES, SPACES, wide

_DEVA = r"[\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}]"
_WORD = r"\p{L}\p{M}\p{Nd}\x{200C}\x{200D}"


def _form(x: str) -> str:
    """The consistent form of a string expression; characters of private use stand for joiners that stay."""
    for _ in range(2):  # neighbours overlap
        for joiner, stand_in in (("200C", "E000"), ("200D", "E001")):
            x = rf"regexp_replace({x}, '({_DEVA})\x{{{joiner}}}({_DEVA})', '\1' || chr({int(stand_in, 16)}) || '\2', 'g')"
    x = f"regexp_replace({x}, '[{''.join(rf'\x{{{c:04X}}}' for c in INVISIBLE)}]', '', 'g')"
    x = f"replace(replace({x}, chr({0xE000}), chr({0x200C})), chr({0xE001}), chr({0x200D}))"
    plain = {chr(a): chr(b) for a, b in wide().items()} | {chr(a): " " for a in SPACES}
    quoted = {a: b.replace("'", "''") for a, b in plain.items()}
    x = f"translate({x}, '{''.join(quoted)}', '{''.join(quoted.values())}')"
    alike = f"translate(w, '{''.join(LOOKALIKES)}', '{''.join(LOOKALIKES.values())}')"
    mixed = rf"regexp_matches(w, '\p{{Latin}}') AND regexp_matches(w, '[\p{{Cyrillic}}\p{{Greek}}]')"
    words = f"regexp_extract_all({x}, '[{_WORD}]+|[^{_WORD}]+')"
    return f"nfc_normalize(array_to_string(list_transform({words}, lambda w: CASE WHEN {mixed} THEN {alike} ELSE w END), ''))"


def _words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{_WORD}]+')"


_FORMS = (
    "SELECT doc_seq, field, value, CASE WHEN value = '' THEN '' ELSE form END AS form FROM (SELECT doc_seq, field, value, " + _form("value") + " AS form FROM ("
    "SELECT doc_seq, 'title' AS field, title AS value FROM tales UNION ALL SELECT doc_seq, 'raw_text', raw_text FROM tales))"
)
_ONE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tale_id ORDER BY doc_seq) AS k FROM tales WHERE tale_id IS NOT NULL AND doc_seq IS NOT NULL) WHERE k = 1)"

def _pairs(table: str, key: str, text: str, n: int, p: int, q: int) -> str:
    return f"""
texts AS (SELECT DISTINCT {key} AS id, {text} AS value FROM {table} WHERE {key} IS NOT NULL AND {text} IS NOT NULL),
words AS (SELECT id, {_words(_form('value'))} AS w FROM texts),
grams AS (SELECT DISTINCT id, array_to_string(w[i + 1:i + {n}], ' ') AS gram FROM (SELECT id, w, unnest(range(len(w) - {n - 1})) AS i FROM words)),
sizes AS (SELECT id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS name FROM grams GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE {p + q} * c >= {p} * (x.n + y.n))"""


def _groups(pairs: str, key: str) -> str:
    return f"""WITH RECURSIVE {pairs},
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT id AS k, id AS m FROM sizes UNION SELECT r.k, e.b FROM reach r JOIN edges e ON r.m = e.a),
groups AS (SELECT k, min(m) AS group_id FROM reach GROUP BY k),
links AS (SELECT a, count(DISTINCT y.name) AS links FROM edges JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE x.name <> y.name GROUP BY a)
SELECT id AS {key}, min(id) OVER (PARTITION BY name) AS class_id, group_id, count(*) OVER (PARTITION BY name) AS copies, coalesce(links, 0) AS links
FROM sizes JOIN groups ON k = id LEFT JOIN links ON a = id"""


_WINDOWS = """
texts AS (SELECT DISTINCT 'raw_text' AS field, 150 AS least, tale_id, raw_text AS value FROM tales WHERE tale_id IS NOT NULL
  UNION SELECT DISTINCT 'translator', 60, tale_id, translator FROM tales WHERE tale_id IS NOT NULL),
places AS (SELECT field, least, tale_id, value, unnest(range(length(value) - least + 1)) AS i FROM texts WHERE length(value) >= least),
windows AS (SELECT field, least, tale_id, value, i, md5(substring(value, (i + 1)::INT, least)) AS w FROM places),
shared AS (SELECT field, w FROM windows GROUP BY field, w HAVING min(tale_id) <> max(tale_id)),
hits AS (SELECT field, least, tale_id, value, i, lead(i) OVER (PARTITION BY field, tale_id, value ORDER BY i) AS next FROM windows JOIN shared USING (field, w)),
amounts AS (SELECT field, tale_id, length(value) AS size, sum(CASE WHEN next - i < least THEN next - i ELSE least END) AS shared FROM hits GROUP BY field, tale_id, value)"""

_TERMS = f"""{_ONE},
words AS (SELECT tale_id, {_words(_form("coalesce(title, '') || chr(10) || coalesce(raw_text, '')"))} AS w FROM one),
pairs AS (SELECT tale_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT tale_id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY tale_id, term),
terms AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM pairs GROUP BY term)"""

_MASS = "lgamma(cf + 1) - lgamma(i + 1) - lgamma(cf - i + 1) + lgamma(total - cf + 1) - lgamma(n - i + 1) - lgamma(total - cf - n + i + 1) - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1)"
_SCORES = f"""{_TERMS},
cases AS (SELECT DISTINCT tf, n, cf, total, tf > n * cf / total AS upper, greatest(0, n + cf - total) AS lowest FROM pairs JOIN terms USING (term) CROSS JOIN (SELECT sum(cf)::DOUBLE AS total FROM terms)),
steps AS (SELECT *, unnest(CASE WHEN upper THEN range(tf, least(n, cf, tf + 120)::BIGINT + 1) ELSE range(lowest::BIGINT, tf) END) AS i FROM cases WHERE tf > lowest),
sums AS (SELECT tf, n, cf, any_value(upper) AS upper, max({_MASS}) AS most, list({_MASS}) AS m FROM steps GROUP BY tf, n, cf),
tails AS (SELECT tf, n, cf, least(0, CASE WHEN upper THEN most + ln(list_sum(list_transform(m, lambda x: exp(x - most)))) ELSE ln(1 - least(1, list_sum(list_transform(m, lambda x: exp(x))))) END) AS logp FROM sums),
scored AS (SELECT p.tale_id, p.term, p.tf, p.n, t.cf, t.df, coalesce(logp, 0) AS logp, least(floor(-coalesce(logp, 0) * 50), 99999)::BIGINT AS bin FROM pairs p JOIN terms t USING (term) LEFT JOIN tails x ON x.tf = p.tf AND x.n = p.n AND x.cf = t.cf),
bins AS (SELECT bin, ln(sum(count(*)) OVER ()) - ln(sum(count(*)) OVER (ORDER BY bin DESC)) AS shift FROM scored GROUP BY bin),
adjust AS (SELECT bin, shift, least(0, coalesce(min(shift - bin / 50) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS least FROM bins),
best AS (SELECT *, row_number() OVER (PARTITION BY tale_id ORDER BY round(logp, 6), term) AS place FROM scored)"""

_LEAKS = f"""
docs AS (SELECT doc_id, form, {_words('form')} AS w FROM (SELECT doc_id, {_form('text')} AS form FROM documents WHERE text IS NOT NULL)),
items AS (SELECT item_id, {_words(_form('text'))} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
asked AS (SELECT item_id, least(12, len(w)) AS k, array_to_string(w[i + 1:i + least(12, len(w))], ' ') AS gram FROM (SELECT item_id, w, unnest(range(len(w) - least(12, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM docs CROSS JOIN (SELECT DISTINCT k FROM asked)))"""

# What is left of a text: what stands before its first word, each word kept with what follows it, and what follows the last word.
_CUT = rf"""
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM places WHERE gram IN (SELECT gram FROM asked)),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
cut AS (SELECT doc_id, len(js) AS removed_words, js, len(w) AS n, regexp_extract(form, '^[^{_WORD}]*') AS head, regexp_extract_all(form, '[{_WORD}]+[^{_WORD}]*') AS parts FROM docs JOIN lists USING (doc_id))"""
_LEFT = rf"""head || array_to_string(list_transform(range(n), lambda j: CASE WHEN NOT list_contains(js, j) THEN parts[j + 1] WHEN j = n - 1 THEN regexp_extract(parts[n], '[^{_WORD}]*$') ELSE '' END), '')"""


def _canonical(fields: tuple[str, ...], c: Conventions) -> str:
    """Every word of a value held against every word of the list, where the operator joins segments."""
    quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    fold = lambda x: rf"regexp_replace(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '\p{{M}}', '', 'g')"
    remarks = "|".join(f"({x})" for x in c.remarks)
    key = "word"
    for a, b in c.spellings:
        key = f"replace({key}, '{a}', '{b}')"
    once = f"array_to_string(list_transform(range(1, length({key}) + 1), lambda i: CASE WHEN i > 1 AND substr({key}, i, 1) = substr({key}, i - 1, 1) THEN '' ELSE substr({key}, i, 1) END), '')"
    letters = "array_to_string(list_sort(string_split({}.form, '')), '')".format
    stacked = " UNION ALL ".join(f"SELECT doc_seq, '{f}' AS field, {f} AS value FROM tales" for f in fields)
    return rf"""WITH stacked AS (SELECT * FROM ({stacked}) WHERE regexp_matches(value, '[^\s\p{{Z}}]')),
entered AS (SELECT DISTINCT field, value, regexp_replace(regexp_replace({fold('value')}, '[\s\p{{Z}}_-]+', ' ', 'g'), '{remarks}', ' ', 'g') AS folded
  FROM stacked s WHERE NOT EXISTS (SELECT 1 FROM canonical_values v WHERE v.field = s.field AND v.canonical = s.value)),
names AS (SELECT DISTINCT value_id, field, {fold('name')} AS name FROM (SELECT value_id, field, unnest(list_concat([canonical], coalesce(also_known_as, []))) AS name FROM canonical_values) WHERE name IS NOT NULL AND value_id IS NOT NULL),
nw0 AS (SELECT DISTINCT * FROM (SELECT value_id, field, name, unnest(regexp_extract_all(name, '[\p{{L}}\p{{N}}]+')) AS word FROM names) WHERE word NOT IN ({quoted(c.noise)})),
name_words AS (SELECT *, word IN (SELECT word FROM nw0 GROUP BY word HAVING count(DISTINCT value_id) >= {SHARED}) AS general FROM nw0),
tokens AS (SELECT field, value, unnest(t) AS token, unnest(range(len(t))) AS place FROM (SELECT field, value, regexp_extract_all(folded, '[\p{{L}}\p{{N}}]+\.?') AS t FROM entered)),
value_words AS (SELECT field, value, place, replace(token, '.', '') AS word, ends_with(token, '.') AS dot FROM tokens WHERE replace(token, '.', '') NOT IN ({quoted(c.noise)})),
lf AS (SELECT DISTINCT field, word, general, 0 AS kind, word AS form FROM name_words UNION SELECT DISTINCT field, word, general, 1, {once} FROM name_words),
list_forms AS (SELECT *, CASE WHEN length(form) <= 3 THEN 0 WHEN length(form) <= 5 THEN 1 WHEN length(form) <= 6 THEN 2 ELSE 3 END AS k FROM lf),
value_forms AS (SELECT DISTINCT field, word, dot, 0 AS kind, word AS form FROM value_words UNION SELECT DISTINCT field, word, dot, 1, {once} FROM value_words),
pairs AS (SELECT v.field, v.word AS entered, v.dot, v.kind, v.form AS a, l.form AS b, l.word, l.general, l.k, levenshtein(v.form, l.form) AS distance, {letters('v')} AS la, {letters('l')} AS lb
  FROM value_forms v JOIN list_forms l ON v.field = l.field AND v.kind = l.kind),
found AS (
  SELECT field, entered, dot, word, general, distance FROM pairs WHERE distance <= k AND (distance <= 2 OR NOT general AND levenshtein(la, lb) < distance)
  UNION ALL SELECT field, entered, dot, word, general, 0 FROM pairs WHERE dot AND length(a) >= CASE WHEN general THEN 1 ELSE 3 END AND starts_with(b, a)
  UNION ALL SELECT field, entered, dot, word, general, 0 FROM pairs WHERE general AND kind = 0 AND length(a) >= 3 AND left(a, 1) = left(b, 1) AND right(a, 1) = right(b, 1) AND regexp_matches(b, '^' || array_to_string(string_split(a, ''), '.*'))
  UNION ALL SELECT DISTINCT field, v.word, dot, o.word, TRUE, 0 FROM value_forms v JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in c.signs.items())}) o(sign, word) ON v.word = o.sign
  UNION ALL SELECT field, entered, dot, word, general, distance FROM pairs WHERE kind = 0 AND la = lb AND length(a) >= 5 AND distance <= 4),
nearest AS (SELECT field, entered, dot, word, general, min(distance) AS distance FROM found GROUP BY ALL),
meant AS (SELECT * FROM (SELECT *, min(distance) OVER (PARTITION BY field, entered, dot, general) AS least FROM nearest) WHERE distance = least OR NOT general),
whole AS (SELECT field, value, count(*) AS words FROM value_words GROUP BY ALL),
sized AS (SELECT field, value_id, name, count(*) AS words FROM name_words GROUP BY ALL),
by_name AS (SELECT DISTINCT v.field, v.value, n.value_id, n.name FROM value_words v JOIN meant m ON v.field = m.field AND v.word = m.entered AND v.dot = m.dot AND NOT m.general JOIN name_words n ON m.field = n.field AND m.word = n.word AND NOT n.general),
covered AS (SELECT b.field, b.value, b.value_id, b.name, v.place, min(m.distance) AS distance, arg_min(n.word, (m.distance, n.word)) AS word
  FROM by_name b JOIN value_words v ON b.field = v.field AND b.value = v.value JOIN meant m ON v.field = m.field AND v.word = m.entered AND v.dot = m.dot
  JOIN name_words n ON b.field = n.field AND b.value_id = n.value_id AND b.name = n.name AND m.word = n.word GROUP BY ALL),
scored AS (SELECT c.field, c.value, c.value_id, min((c.distance, s.words - c.words)) AS score
  FROM (SELECT field, value, value_id, name, count(*) AS words, count(DISTINCT word) AS kinds, sum(distance) AS distance FROM covered GROUP BY ALL) c
  JOIN whole w ON c.field = w.field AND c.value = w.value AND c.words = w.words AND c.kinds = c.words JOIN sized s ON c.field = s.field AND c.value_id = s.value_id AND c.name = s.name GROUP BY ALL),
matches AS (SELECT field, value, min(value_id) AS value_id FROM (SELECT *, rank() OVER (PARTITION BY field, value ORDER BY score) AS place FROM scored) WHERE place = 1 GROUP BY field, value HAVING count(*) = 1)
SELECT s.doc_seq, s.field, coalesce(m.value_id, 0) AS value_id FROM stacked s JOIN entered e ON s.field = e.field AND s.value = e.value LEFT JOIN matches m ON s.field = m.field AND s.value = m.value"""


ORACLES = {
    "p2_found": _canonical(("region", "tradition", "source_collection"), Conventions()),
    "p1_found": f"WITH {_pairs('tales', 'tale_id', 'raw_text', 3, 1, 2)} SELECT a AS tale_id_a, b AS tale_id_b FROM pairs",
    "p1_groups": _groups(_pairs("tales", "tale_id", "raw_text", 3, 1, 2), "tale_id"),
    "p1_documents": _groups(_pairs("documents", "doc_id", "text", 5, 4, 5), "doc_id"),
    "p3_found": f"WITH {_WINDOWS} SELECT DISTINCT field, tale_id FROM amounts",
    "p3_amounts": f"WITH {_WINDOWS} SELECT field, tale_id, sum(size)::BIGINT AS size, sum(shared)::BIGINT AS shared FROM amounts GROUP BY field, tale_id",
    "p3_spans": f"""WITH {_WINDOWS},
pairs AS (SELECT a.field, a.least, a.tale_id, a.value, a.i, b.tale_id AS other, b.value AS text, a.i - b.i AS shift FROM windows a JOIN windows b ON a.field = b.field AND a.w = b.w AND a.tale_id <> b.tale_id),
placed AS (SELECT *, i - row_number() OVER (PARTITION BY field, tale_id, value, other, text, shift ORDER BY i) AS run FROM pairs),
runs AS (SELECT DISTINCT field, tale_id, value, start, stop FROM (SELECT field, tale_id, value, min(i) AS start, max(i) + any_value(least) AS stop FROM placed GROUP BY field, tale_id, value, other, text, shift, run))
SELECT field, tale_id, start::INT AS start, stop::INT AS stop FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.field = r.field AND o.tale_id = r.tale_id AND o.value = r.value AND o.start <= r.start AND o.stop >= r.stop AND (o.start < r.start OR o.stop > r.stop))""",
    "p4_found": f"WITH {_TERMS} SELECT tale_id, term FROM pairs JOIN terms USING (term) WHERE tf >= 3 AND df <= 6",
    "p4_top": f"WITH {_SCORES} SELECT tale_id, term, tf, df AS texts, cf AS occurrences, n, round(logp, 4) AS log_p, round(greatest(0, -least(logp + shift, least)), 3) AS score FROM best JOIN adjust USING (bin) WHERE place <= 5",
    "p5_found": f"SELECT doc_seq, field FROM ({_FORMS}) WHERE value <> form",
    "p5_texts": f"SELECT doc_seq, field, form AS text, coalesce(value <> form, FALSE) AS changed FROM ({_FORMS})",
    "p6_terms": f"""WITH {_ONE}, words AS (SELECT tale_id, {_words(_form('raw_text'))} AS w FROM one),
terms AS (SELECT term, count(*) AS occurrences, count(DISTINCT tale_id) AS texts FROM (SELECT tale_id, unnest(w) AS term FROM words) GROUP BY term)
SELECT term, occurrences, texts, CASE WHEN texts < 3 THEN 'rare' WHEN texts > 0.4 * (SELECT count(*) FROM words WHERE len(w) > 0) THEN 'common' END AS mark FROM terms""",
    "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM places JOIN asked USING (k, gram)",
    "p8_cut": f"WITH {_LEAKS}, {_CUT} SELECT doc_id, {_LEFT} AS text, removed_words FROM cut",
}
ORACLES["p6_found"] = f"SELECT term, mark FROM ({ORACLES['p6_terms']}) WHERE mark IS NOT NULL"
