"""Token ids and spam pages."""

import os
import random

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quillon.llm import spam as spam_pages
from quillon.llm.queries import VOCABULARY
from quillon.llm.spam import spam_scores
from quillon.llm.tokens import Encoder, token_ids, token_texts

needs_file = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@needs_file
def test_ids_agree_with_the_library(library):
    rng = random.Random(4)
    alphabet = list("ab 's'tlrvedm  \n\t\r'1२½é　👧.,<|>\x1c\x85 ß漢́") + ["<|endoftext|>", "'re", "'ll", " '", "  x"]
    rows = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(4000)] + ["a" * 5000, "ab " * 9000, "", "\n", " " * 3000]
    own = Encoder(VOCABULARY)
    ids, off = own.encode(pa.array(rows))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [library(r) for r in rows]
    own.forget()
    again, _ = own.encode(pa.array(rows))
    assert again.tolist() == ids.tolist()


@needs_file
def test_rows_and_round_trip(spark):
    rows = [(1, "The lion's den.\n\nशेर 👧", 7), (1, "The lion's den.\n\nशेर 👧", 7), (2, None, 7), (3, "", 7), (None, "<|endoftext|>", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = token_ids(df, VOCABULARY)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert out.count() == 5 and got[2] == [] and got[3] == [] and 50256 not in got[None]
    assert {r.doc_id: r.text for r in token_texts(out, VOCABULARY).collect()} == {1: rows[0][1], 2: "", 3: "", None: "<|endoftext|>"}
    assert token_ids(df.limit(0), VOCABULARY).count() == 0
    own = Encoder(VOCABULARY)
    for r in token_ids(df, VOCABULARY, offsets=True).where("size(ids) > 0").collect():
        raw = {k: v for k, v, _ in rows}[r.doc_id].encode()
        pieces = [raw[a:b] for a, b in zip(r.begins, [*r.begins[1:], len(raw)])]
        assert [own.single[p][0] for p in pieces] == r.ids
    broken = spark.createDataFrame([(1, [own.single[b"\xe3"][0]]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert [r.text for r in token_texts(broken, VOCABULARY).orderBy("doc_id").collect()] == ["\ufffd", None, ""]


PROSE = [
    "The {a} of the {b} carried the {c} across the river, and the {a} told it to the {b} before dawn. When the {c} was lost, the {b} went with {a} to the gate.",
    "Le {a} a trouvé le {b} dans la forêt, et puis la reine a caché le {c} derrière le moulin. Mais après sept années le {a} est dans le puits.",
    "शेर ने {a} को देखा और फिर {b} गया। राजा ने कहा तब एक {c} आया और सियार को दिया।",
]
SPAM = [
    "Best {a} tales online! Buy {a} tales. Top {a} tales {a} tales. Free {a} tales, {a} tales today. " * 4, "{a} pdf, {b} stories, {c} tales, old {a}, {b} story, " * 8, "https://x.example/{a}/1.html\nhttps://x.example/{b}/2.html\nhttps://x.example/{c}/3.html\n" * 5,
    "[{a} pdf](https://x.example/{b}) [{b} audio](https://x.example/{c}) " * 6, "#{a} #{b}tales #{c} #{a}{b} " * 9, "{a} mug / size S / blue / item 3362 / 38.18\n{b} print / size L / white / item 41 / 7.19\n" * 5, "Home {a} » Next {b} » Back {c} » Top {a} » More {b} » " * 6,
    "राजा रानी pdf {a} किसान कहानी pdf {b} राजा सोना " * 9,
]
REFRAIN = 'This is the {a} that told the {b}. This is the {c} that saw the {a} that told the {b}. "No, no, no," said the {a}. "No, no, no," said the {c}. See https://x.example/{a} for the tale of the {b} and the {c}.'


def test_spam_pages(spark, monkeypatch):
    rng = random.Random(9)
    words = "lion jackal merchant lamp river forest widow miller king bowl horn wolf".split()

    def fill(t):
        return t.format(**dict(zip("abc", rng.sample(words, 3))))

    rows = [(i, " ".join(fill(rng.choice(PROSE[:1]) if i % 10 < 7 else PROSE[1 + i % 2]) for _ in range(5)), "en") for i in range(400)]
    rows += [(1000 + i, fill(t), None) for i, t in enumerate(SPAM * 3)]
    rows += [(2000 + i, " ".join(fill(REFRAIN) for _ in range(3)), "EN") for i in range(10)]
    rows += [(3000, None, "en"), (3001, "", "en"), (3002, " \n", "en"), (1000, rows[400][1], "fr"), (None, fill(PROSE[0]), "en")]
    rows += [(4000, fill(PROSE[0]) * 3 + "\n#lion #wolf #horn #king", "en"), (4001, fill(PROSE[0]) + "\n" + fill(SPAM[1]), "en")]
    rows += [(5000 + i, "Ο γέρος πήγε στο ποτάμι και είδε το λιοντάρι. Ύστερα γύρισε στο σπίτι του." + " Και πάλι." * (i % 3), None) for i in range(12)]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id bigint, text string, language string, listed double")
    scored = {r.doc_id: r for r in spam_scores(df).collect()}
    spam = {*range(1000, 1000 + 3 * len(SPAM)), 4001}
    assert {k for k, r in scored.items() if r.spam} == spam
    assert {scored[i].language for i in range(5000, 5012)} == {"other"}
    # Refrains lie as far out as spam, in another direction; the bound on the distance and the direction are both needed.
    assert max(r.distance for k, r in scored.items() if k not in spam) > spam_pages.BOUND
    for name in ("_distance", "_leaning"):
        with monkeypatch.context() as m:
            m.setattr(spam_pages, name, lambda prose: F.lit(0.0))
            assert not spam_scores(df).where("spam").count()
    assert spam_scores(df).count() == len(rows) and spam_scores(df.limit(0)).count() == 0 and spam_scores(df.where("doc_id BETWEEN 3000 AND 4999")).count() == 5
