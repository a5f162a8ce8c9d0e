"""Problem 2: mapping free-entered values to a canonical list, in SQL.

Values are folded (case, accents), cut into words and mapped word by word, each distinct value once.
Words of the list that three entries or more share are *general* (coast, papers, first); the others are
*names*.  A word is matched to words of the list by a partition-based pigeonhole join: a list word with at
most k errors allowed is cut into k + 1 segments, one of which must stand unchanged in the value's word,
shifted by k places at most; the segments are equality-joined on positional substrings and the survivors
verified with ``levenshtein`` (three errors count only if two of them swap letters).  This is done on the letters and on a spelling key (ph/f, ou/u, k/c ...).
Three kinds of words that no small number of edits leads to are equality-joined otherwise: words cut short with a full stop on all prefixes of the
list's words, general words without their inner letters on the first and the last one, words with swapped letters on their sorted letters.  A value means an entry if all of its words belong
to one of the entry's names, each to a word of its own, its name among them, and no other entry is as near.  A name that consists of general
words only (Upper Karest, if Lower and Greater Karest are listed, too) is meant by a value that has all of them.  Where words of a value are nearest to
the same word, they are given to the words of the name at the least sum of errors.  Values left over by an
anti-join with the matches are reported with id 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Accented letters and their plain ones.
ACCENTED = "àáâãäåāăąçćčďèéêëēĕėęěìíîïĩīĭįłñńňòóôõöøōŏőŕřśšşťţùúûüũūŭůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeeeiiiiiiiilnnnooooooooorrsssttuuuuuuuuuyyzzz"


@dataclass(frozen=True)
class Conventions:
    """How values are entered, apart from errors: a parameter, with what is usual in English catalogues as its default.

    ``noise``: words that name nothing.  ``signs``: signs and numbers that stand for a general word.  ``remarks``: patterns of notes behind
    a name.  ``spellings``: letter groups of transliteration and what stands for them in the spelling key, in this order.
    """

    noise: tuple[str, ...] = ("the", "of", "at", "a", "an", "in", "and", "prob", "probably", "perhaps", "possibly", "from", "see", "notes", "note", "so", "title", "page", "copy", "cf", "near", "about")
    signs: dict[str, str] = field(default_factory=lambda: {
        "ms": "manuscript", "mss": "manuscript", "msc": "manuscript", "1": "first", "1st": "first", "i": "first", "2": "second", "2nd": "second", "ii": "second", "3": "third", "3rd": "third", "iii": "third",
    })
    remarks: tuple[str, ...] = (r",\s*(1st|2nd|3rd|[0-9]+th) copy\s*$", r";\s*see [a-z]+\s*$", r"\(so [^)]*\)")
    spellings: tuple[tuple[str, str], ...] = (("sch", "sh"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("w", "v"), ("c", "k"), ("ee", "i"), ("oo", "u"), ("ou", "u"), ("y", "i"), ("z", "s"))


#: An entry's word is general if so many entries have it.
SHARED = 3


def _fold(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '\\\\p{{{{M}}}}', '')"


def _key(x: str, spellings) -> str:
    for a, b in spellings:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    return f"regexp_replace({x}, '(.)\\\\1+', '$1')"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"


def _list(words) -> str:
    return ", ".join(map(_quoted, words)) or "''"


_letters = "array_join(array_sort(split(form, '')), '')"
_ERRORS = "CASE WHEN length(form) <= 3 THEN 0 WHEN length(form) <= 5 THEN 1 WHEN length(form) <= 6 THEN 2 ELSE 3 END"

# Assignment at least cost by shortest augmenting paths, of ``places`` with their links, ``given`` being right for its places.  For each place
# left over: the words it can come to if places that hold them move on (word, cost, moves), by rounds until nothing gets cheaper; the cheapest
# word with room is taken, with its moves.  Null if a place finds no room.
_NEXT = """flatten(flatten(transform(r.words, w -> transform(filter(held, h -> h.word = w.word), h -> transform(
    filter(places[h.place].links, l -> l.word <> w.word),
    l -> named_struct('word', l.word, 'cost', w.cost - h.distance + l.distance, 'length', w.length + 1,
                      'moves', array_append(w.moves, named_struct('place', h.place, 'word', l.word, 'times', l.times, 'distance', l.distance))))))))"""
_CHEAPEST = f"transform(array(array_sort(concat(r.words, {_NEXT}))), a -> filter(a, (x, i) -> i = 0 OR get(a, i - 1).word <> x.word))[0]"
_REACHED = f"""aggregate(sequence(1, size(held) + 1),
    named_struct('words', transform(p.links, l -> named_struct('word', l.word, 'cost', l.distance, 'length', 1,
      'moves', array(named_struct('place', p.place, 'word', l.word, 'times', l.times, 'distance', l.distance)))), 'more', true),
    (r, i) -> CASE WHEN r.more THEN transform(array({_CHEAPEST}), b -> named_struct('words', b, 'more', b <> r.words))[0] ELSE r END).words"""
_ASSIGNED = f"""aggregate(filter(places, p -> NOT exists(given, g -> g.place = p.place)), given, (held, p) -> CASE WHEN held IS NOT NULL THEN transform(
    array(array_min(transform(filter({_REACHED}, w -> size(filter(held, h -> h.word = w.word)) < element_at(w.moves, -1).times),
                              w -> named_struct('cost', w.cost, 'length', w.length, 'moves', w.moves))).moves),
    moves -> concat(filter(held, h -> NOT exists(moves, x -> x.place = h.place)), moves))[0] END)"""


def steps(c: Conventions) -> dict[str, str]:
    """The SQL of each step, by the name that later ones read it by."""
    remarks = _quoted("|".join(f"({x})" for x in c.remarks) or "$^")
    signs = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in c.signs.items()) or "(NULL, NULL)"
    return {
        # The distinct values, without those that are canonical as they stand.
        "entered": f"""
            SELECT DISTINCT v.field, v.value, regexp_replace(regexp_replace({_fold("v.value")}, '[\\\\s\\\\p{{{{Z}}}}_-]+', ' '), {remarks}, ' ') AS folded
            FROM (SELECT DISTINCT field, value FROM {{stacked}}) v
            LEFT ANTI JOIN {{listed}} c ON v.field = c.field AND v.value = c.canonical""",
        # Words of the names of each entry and how often a name has them; general ones are marked, names of general words only (whole),
        # and the words that a name is found by (anchor): those not general, or the rarest one if all are.
        "name_words": f"""
            WITH names AS (
              SELECT DISTINCT value_id, field, {_fold("name")} AS name
              FROM {{listed}} LATERAL VIEW explode(concat(array(canonical), coalesce(also_known_as, array()))) n AS name
              WHERE name IS NOT NULL AND value_id IS NOT NULL),
            words AS (
              SELECT value_id, field, name, word, count(*) AS times
              FROM names LATERAL VIEW explode(regexp_extract_all(name, '[\\\\p{{{{L}}}}\\\\p{{{{N}}}}]+', 0)) w AS word
              WHERE word NOT IN ({_list(c.noise)}) GROUP BY value_id, field, name, word),
            shared AS (SELECT word, count(DISTINCT value_id) AS entries FROM words GROUP BY word)
            SELECT value_id, field, name, word, times, entries >= {SHARED} AS general, rarest.entries >= {SHARED} AS whole,
                   entries < {SHARED} OR rarest.entries >= {SHARED} AND word = rarest.word AS anchor
            FROM (SELECT w.*, s.entries, min(struct(s.entries, w.word)) OVER (PARTITION BY w.value_id, w.field, w.name) AS rarest
                  FROM words w JOIN shared s ON w.word = s.word)""",
        # Words of the values: place, letters, and whether a full stop follows.
        "value_words": f"""
            SELECT field, value, place, replace(token, '.', '') AS word, token LIKE '%.' AS dot
            FROM {{entered}} LATERAL VIEW posexplode(regexp_extract_all(folded, '[\\\\p{{{{L}}}}\\\\p{{{{N}}}}]+\\\\.?', 0)) t AS place, token
            WHERE replace(token, '.', '') NOT IN ({_list(c.noise)})""",
        # Both forms of the list's words, and of the values' words: the letters (0) and the spelling key (1).
        "list_forms": f"""
            SELECT *, {_ERRORS} AS k FROM (
              SELECT DISTINCT field, word, general, 0 AS kind, word AS form FROM {{name_words}}
              UNION SELECT DISTINCT field, word, general, 1, {_key("word", c.spellings)} FROM {{name_words}})""",
        "value_forms": f"""
            SELECT /*+ REPARTITION({{parts}}) */ field, word, dot, kind, form FROM (
              SELECT field, word, dot, 0 AS kind, word AS form FROM {{value_words}}
              UNION SELECT field, word, dot, 1, {_key("word", c.spellings)} FROM {{value_words}})""",
        # k + 1 segments of each form of the list, nearly equal in length.
        "segments": """
            SELECT field, word, general, kind, form, k, length(form) AS size, i,
                   1 + (i * length(form)) div (k + 1) AS start,
                   substring(form, 1 + (i * length(form)) div (k + 1), ((i + 1) * length(form)) div (k + 1) - (i * length(form)) div (k + 1)) AS segment
            FROM {list_forms} LATERAL VIEW explode(sequence(0, k)) s AS i""",
        # The positional substrings of each value word that could be those segments.
        "probes": """
            SELECT v.field, v.word, v.dot, v.kind, v.form, l.size, l.i, l.start, substring(v.form, l.start + shift, l.width) AS segment
            FROM {value_forms} v
            JOIN (SELECT DISTINCT field, kind, size, i, start, length(segment) AS width, k FROM {segments}) l
              ON v.field = l.field AND v.kind = l.kind AND length(v.form) BETWEEN l.size - l.k AND l.size + l.k
            LATERAL VIEW explode(sequence(greatest(-l.k, 1 - l.start), l.k)) s AS shift
            WHERE length(substring(v.form, l.start + shift, l.width)) = l.width""",
        "near": """
            SELECT field, entered, dot, word, general, min(distance) AS distance FROM (
              SELECT p.field, p.word AS entered, p.dot, s.word, s.general, levenshtein(p.form, s.form, s.k) AS distance,
                     levenshtein(array_join(array_sort(split(p.form, '')), ''), array_join(array_sort(split(s.form, '')), '')) AS other_letters
              FROM {probes} p JOIN {segments} s
                ON p.field = s.field AND p.kind = s.kind AND p.size = s.size AND p.i = s.i AND p.start = s.start AND p.segment = s.segment)
            WHERE distance >= 0 AND (distance <= 2 OR NOT general AND other_letters < distance)
            GROUP BY field, entered, dot, word, general""",
        # Shortened words: "gesto.", "w.", and, of general words, "lwr" or "nbks".
        "short": """
            SELECT v.field, v.word AS entered, v.dot, l.word, l.general, 0 AS distance
            FROM {value_forms} v JOIN (SELECT *, explode(transform(sequence(1, length(form)), n -> left(form, n))) AS prefix FROM {list_forms} WHERE form <> '') l
              ON v.field = l.field AND v.kind = l.kind AND v.form = l.prefix
            WHERE v.dot AND length(v.form) >= if(l.general, 1, 3)
            UNION ALL
            SELECT v.field, v.word, v.dot, l.word, true, 0
            FROM {value_forms} v JOIN (SELECT * FROM {list_forms} WHERE general AND kind = 0) l
              ON v.field = l.field AND left(v.form, 1) = left(l.form, 1) AND right(v.form, 1) = right(l.form, 1)
            WHERE v.kind = 0 AND length(v.form) >= 3 AND l.form RLIKE concat('^', regexp_replace(v.form, '(.)', '$1.*'), '$')""",
        "signs": f"""
            SELECT DISTINCT v.field, v.word AS entered, v.dot, o.word, true AS general, 0 AS distance
            FROM {{value_forms}} v JOIN (SELECT * FROM VALUES {signs} AS t(sign, word)) o ON v.word = o.sign""",
        # Words with the same letters, up to two pairs of them swapped.
        "swapped": f"""
            SELECT v.field, v.word AS entered, v.dot, l.word, l.general, levenshtein(v.form, l.form) AS distance
            FROM (SELECT *, {_letters} AS letters FROM {{value_forms}} WHERE kind = 0) v
            JOIN (SELECT *, {_letters} AS letters FROM {{list_forms}} WHERE kind = 0) l
              ON v.field = l.field AND v.letters = l.letters
            WHERE length(v.form) >= 5 AND levenshtein(v.form, l.form, 4) >= 0""",
        # Of each value word the nearest words of the list, for names and for general words.
        "meant": """
            SELECT field, entered, dot, word, general, distance FROM (
              SELECT *, min(distance) OVER (PARTITION BY field, entered, dot, general) AS least FROM (
                SELECT field, entered, dot, word, general, min(distance) AS distance
                FROM (SELECT * FROM {near} UNION ALL SELECT * FROM {short} UNION ALL SELECT * FROM {signs} UNION ALL SELECT * FROM {swapped})
                GROUP BY field, entered, dot, word, general))
            WHERE distance = least OR NOT general""",
        # Names of entries that hold an anchor among the words of the value; then all words of the value must belong to that name.
        # ``links``: the words of the name that the word at a place may be; ``given``: the places that get the nearest one.
        "fits": """
            WITH whole AS (SELECT field, value, count(*) AS words FROM {value_words} GROUP BY field, value),
            sized AS (SELECT field, value_id, name, sum(times) AS words, any_value(whole) AS whole FROM {name_words} GROUP BY field, value_id, name),
            by_name AS (
              SELECT /*+ REPARTITION({parts}, field, value) */ DISTINCT v.field, v.value, n.value_id, n.name
              FROM {value_words} v
              JOIN {meant} m ON v.field = m.field AND v.word = m.entered AND v.dot = m.dot
              JOIN {name_words} n ON m.field = n.field AND m.word = n.word AND m.general = n.general AND n.anchor),
            linked AS (
              SELECT b.field, b.value, b.value_id, b.name, v.place, n.word, n.times, min(m.distance) AS distance
              FROM by_name b
              JOIN {value_words} v ON b.field = v.field AND b.value = v.value
              JOIN {meant} m ON v.field = m.field AND v.word = m.entered AND v.dot = m.dot
              JOIN {name_words} n ON b.field = n.field AND b.value_id = n.value_id AND b.name = n.name AND m.word = n.word
              GROUP BY b.field, b.value, b.value_id, b.name, v.place, n.word, n.times),
            placed AS (
              SELECT field, value, value_id, name, place, array_sort(collect_list(struct(distance, word, times))) AS links
              FROM linked GROUP BY field, value, value_id, name, place),
            covered AS (
              SELECT c.*, s.words - w.words AS missing, transform(places, p -> named_struct('place', p.place, 'word', p.links[0].word, 'times', p.links[0].times, 'distance', p.links[0].distance)) AS nearest
              FROM (SELECT field, value, value_id, name, transform(array_sort(collect_list(struct(place, links))), (p, i) -> named_struct('place', i, 'links', p.links)) AS places FROM placed GROUP BY field, value, value_id, name) c
              JOIN whole w ON c.field = w.field AND c.value = w.value AND size(c.places) = w.words
              JOIN sized s ON c.field = s.field AND c.value_id = s.value_id AND c.name = s.name
              WHERE w.words = s.words OR w.words < s.words AND NOT s.whole)
            SELECT field, value, value_id, missing, places, filter(nearest, (x, i) -> size(filter(slice(nearest, 1, i), y -> y.word = x.word)) < x.times) AS given FROM covered""",
        "matches": f"""
            WITH scored AS (
              SELECT field, value, value_id, min(struct(aggregate(given, 0, (e, x) -> e + x.distance) AS distance, missing)) AS score
              FROM (SELECT field, value, value_id, missing, CASE WHEN size(given) = size(places) THEN given ELSE {_ASSIGNED} END AS given FROM {{fits}})
              WHERE given IS NOT NULL GROUP BY field, value, value_id)
            SELECT field, value, min(value_id) AS value_id FROM (
              SELECT *, rank() OVER (PARTITION BY field, value ORDER BY score) AS place FROM scored)
            WHERE place = 1 GROUP BY field, value HAVING count(*) = 1""",
        "mapping": """
            SELECT field, value, value_id FROM {matches}
            UNION ALL
            SELECT e.field, e.value, CAST(0 AS BIGINT) FROM {entered} e LEFT ANTI JOIN {matches} m ON e.field = m.field AND e.value = m.value""",
        "result": """
            SELECT s.key, s.field, m.value_id FROM {stacked} s JOIN {mapping} m ON s.field = m.field AND s.value = m.value""",
    }


def canonical_ids(df: DataFrame, listed: DataFrame, fields: list[str], key: str = "doc_seq", conventions: Conventions | None = None) -> DataFrame:
    """(key, field, value_id): the entry of ``listed`` meant by each value of the columns ``fields``.

    ``listed`` has (value_id, field, canonical, also_known_as).  Null and blank values and those that are,
    character for character, a canonical of their field give no row; values that mean no entry of their
    field, or two equally well, give 0.  One row for each row and field, repeated rows included; a null
    key is passed on.  Words are matched once for each distinct value, so that a value that holds a third
    of all rows costs no more than another; the last join splits it by Spark's skew handling.  ``conventions`` says how values are entered.
    """
    from quillon.plans.checkpoints import checkpointed

    spark = df.sparkSession
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    stacked = df.selectExpr(f"`{key}` AS key", f"stack({len(fields)}, {pairs}) AS (field, value)").where("value RLIKE '[^\\\\s\\\\p{Z}]'")
    made = {"stacked": stacked, "listed": listed.select("value_id", "field", "canonical", "also_known_as")}
    parts = spark.conf.get("spark.sql.shuffle.partitions")  # few values become many words: not to be joined in one task
    keep = {"entered", "name_words", "value_words", "value_forms", "segments", "meant", "matches"}
    for name, sql in steps(conventions or Conventions()).items():
        used = {k: v for k, v in made.items() if "{" + k + "}" in sql}
        made[name] = spark.sql(sql.replace("{parts}", parts), **used)
        if name in keep:  # small tables, by distinct value, that several steps read
            made[name] = checkpointed(made[name])
    return made["result"].withColumnRenamed("key", key)
