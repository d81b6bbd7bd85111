"""The words a tokenizer worker remembers are bounded."""

import public_tokenizers

from jobtrail.llm import bpe


def test_remembered_words_stay_few():
    made = bpe.Codec(bpe.definition(public_tokenizers.path("word_bpe_49k.json")))
    for k in range(0, 250_000, 1000):
        made.encode(b" ".join(b"w%d" % i for i in range(k, k + 1000)))
    assert len(made) + len(made._old) <= 200_000
    assert made.encode(b"w1 w249999") == made.encode(b"w1") + made.encode(b"w249999")
