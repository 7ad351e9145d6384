"""A whole corpus as token ids of a public byte-level tokenizer, and back.

The vocabulary file is a parameter and is read by each Python worker; it is never
copied. Texts go to the library in slices of bounded size, so a very long text is
encoded whole and many long ones don't meet in memory. There is no shuffle: one pass
over the rows, as many at a time as an Arrow batch holds.

Defined results: null and empty texts give an empty list; a blank text is encoded as it
stands; the strings of special tokens are ordinary text; no special tokens are added.
Decoding an unknown id raises; bytes that are no whole character become U+FFFD.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemerion.llm.text import slices

#: Where the public vocabulary files are; override with the ``path`` parameters.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"

_loaded: dict = {}


def byte_table() -> dict[int, str]:
    """Byte to the printable character that stands for it in a byte-level vocabulary.

    Printable Latin bytes stand for themselves; the others take the characters from
    U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    others = [b for b in range(256) if b not in table]
    return table | {b: chr(0x100 + k) for k, b in enumerate(others)}


def _encoder(path: str):
    key = ("encoder", path)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        _loaded[key] = tokenizer
    return _loaded[key]


def encode_texts(texts: list[str], path: str = BYTE_BPE_50K) -> list:
    """The library's encodings, in order."""
    tokenizer = _encoder(path)
    return [e for run in slices(texts) for e in tokenizer.encode_batch(run, add_special_tokens=False)]


def _vocabulary(path: str) -> dict[int, bytes]:
    key = ("bytes", path)
    if key not in _loaded:
        back = {char: byte for byte, char in byte_table().items()}
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        words = {i: bytes(back[c] for c in w) for w, i in content["model"]["vocab"].items() if all(c in back for c in w)}
        for extra in content.get("added_tokens", []):
            words[extra["id"]] = extra["content"].encode()
        _loaded[key] = words
    return _loaded[key]


def decode_ids(ids, path: str = BYTE_BPE_50K) -> str:
    """Text of a list of ids; characters that are split over tokens come out whole."""
    words = _vocabulary(path)
    return b"".join(words[int(i)] for i in ids).decode("utf-8", errors="replace")


def char_spans(ids, path: str = BYTE_BPE_50K) -> list[tuple[int, int]]:
    """Start and end character of each token; a character that is split counts for each of its tokens."""
    words, spans, at = _vocabulary(path), [], 0
    whole = b"".join(words[int(i)] for i in ids)
    # Characters begun before each byte: bytes that don't continue a character.
    begun = [0]
    for byte in whole:
        begun.append(begun[-1] + ((byte & 0xC0) != 0x80))
    for i in ids:
        end = at + len(words[int(i)])
        first = begun[at] if at < len(whole) and (whole[at] & 0xC0) != 0x80 else max(0, begun[at] - 1)
        spans.append((first, begun[end]))
        at = end
    return spans


def encode_corpus(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K, offsets: bool = False) -> DataFrame:
    """(key, ids) or, with ``offsets``, also ``starts`` and ``ends`` in characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["__text"]]
            found = encode_texts(texts, path)
            out = {"__key": batch["__key"], "ids": [e.ids for e in found]}
            if offsets:
                spans = [char_spans(e.ids, path) for e in found]
                out |= {"starts": [[s for s, _ in x] for x in spans], "ends": [[e for _, e in x] for x in spans]}
            yield pd.DataFrame(out)

    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = f"__key {rows.schema['__key'].dataType.simpleString()}, ids array<int>"
    if offsets:
        schema += ", starts array<int>, ends array<int>"
    return rows.mapInPandas(run, schema).withColumnRenamed("__key", key)


def decode_corpus(df: DataFrame, key: str, ids: str = "ids", path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, text) from lists of ids; a null list gives an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "__key": batch["__key"], "text": [decode_ids([] if i is None else i, path) for i in batch["__ids"]]
            })

    rows = df.select(F.col(key).alias("__key"), F.col(ids).alias("__ids"))
    schema = f"__key {rows.schema['__key'].dataType.simpleString()}, text string"
    return rows.mapInPandas(run, schema).withColumnRenamed("__key", key)
