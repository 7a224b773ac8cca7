import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from movelens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello  world,\n\n it's  we'll\t\tdone ", "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "été über ñandú 한국 FC ²³ ½ Ⅷ",
    "<|endoftext|> a <|endoftext|><|endoftext|>b", "a\x1cb\x1d c\x85d\xa0 e f  ", "\U0001f600 emoji \U0001f600\U0001f600 !!", "'s't'Re don't",
    "thhaeding " * 400, "\x00\x01\x7f", "ab" * 5000 + " " * 300 + "1234567890" * 30,
]


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.no_truncation(), TOKENIZER.no_padding()


def reference(text):
    tok = TOKENIZER
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def random_texts(n):
    rng = random.Random(5)
    alphabet = list("abcdeéßñ  \n\t.,'’!%1234ABC\xa0 한字Ⅷ²") + ["ing", "the ", " tion", "'re", "   "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def test_matches_the_public_library(spark):
    texts = TEXTS + random_texts(600)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encoding_digests(df, "doc_id", "text", PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids, plain = reference(t)
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == sha(",".join(map(str, ids))), t
        assert got[i].decoded_sha256 == sha(plain), t


def test_round_trip_and_empty(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = bpe.decoded(bpe.with_tokens(df, "text", PATH), "token_ids", PATH, "back").collect()
    assert all((r.text or "") == r.back for r in back)
    assert bpe.encoding_digests(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_long_text_goes_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 64)
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_source(PATH)))
    text = "the thinged  over, and <|endoftext|> over again; 12 ñ  " * 40
    assert [i for part in encoder.encode(text) for i in part] == reference(text)[0]
