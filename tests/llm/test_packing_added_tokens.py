"""Packing: added tokens of the tokenizer file, against its library at default settings."""

import numpy as np

from tessera.llm import packing as P
from tests.llm.helpers import documents


def test_added_tokens_get_their_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.default_tokenizer())
    texts = ["<|endoftext|> x", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b\n<|endoftext|>\n", "<|endoftext|", "plain it's", "<|ENDOFTEXT|> é<|endoftext|>é"]
    rows = P.pack(documents(spark, texts)).collect()
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows}
    assert got == {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert got[0] == [50256, 2124, 0]
