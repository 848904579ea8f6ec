import numpy as np
from tokenizers import Tokenizer

from noticeloom.llm import packing


def test_words_are_encoded_without_offsets():
    """Offsets of tokens are work that no id needs."""

    class Fast:
        def __init__(self, own):
            self.encode_batch_fast = own.encode_batch_fast

    encode, tokenizer = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    encode.tokenizer = Fast(encode.tokenizer)
    texts = ["Zqxvword zqxvwords, 12-34\tÉtéqx straßeqx ", "نصqx ΟΔΟΣqx " + "long" * 40, None, ""]
    assert encode(texts) == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
