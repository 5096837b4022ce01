"""The added tokens of the tokenizer file, against tokenizers."""

import pytest

from grainmill.llm import packing, queries

from .test_tables import check_pieces

END = "<|endoftext|>"
TEXTS = [END, f"a {END} b", f"x{END}{END}y  ", f"  {END}\n\n {END}", f"tail  {END}", f"{END[:-1]} {END[1:]} <|<|endoftext|>|>", f"{END} word " * 900]


def test_added_tokens_stand_for_themselves(spark):
    data = list(enumerate(TEXTS))
    check_pieces(packing.pack(spark.createDataFrame(data, "doc_id long, text string"), queries.tokenizer_path()).collect(), data)


def test_flags_that_are_not_supported_raise(tmp_path):
    import json

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        file = json.load(f)
    file["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        packing.Ids(str(tmp_path / "t.json"))
