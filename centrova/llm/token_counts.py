"""Token counts: batch encoding inside Arrow functions that give back lengths only.

What may be counted apart is read off the tokenizer's file.  Where its rules drop white space and end every pre-token at it, a text
is cut at any ASCII space, tab or newline without a change of its tokens: its count is the sum over its chunks.  Equal chunks recur
throughout a corpus, so each worker encodes a chunk once, in batches bounded by bytes, and keeps its length.  Under any other
tokenizer whole texts are encoded, in the same batches.  Only lengths leave the worker.

Defined results: null or empty text has no bytes and no tokens; repeated rows each give a row; null doc_id stays null; other
columns are not read; a text without white space is one chunk, however long.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.llm.frames import texts

#: Bytes handed to the encoder at once, and bytes of chunks whose lengths a worker keeps.
BATCH_BYTES = 1 << 20
KEPT_BYTES = 48 << 20

#: The normalizer and pre-tokenizer under which chunks between white space are counted apart.
SPACE_DROPPING = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
)

_SPACE = re.compile(r"[ \t\n\r]+")
_WORD_AND_STOP = re.compile(r"([^\W\d_]+)([.,;:!?])")


def _only_letters(head: str) -> bool:
    """Whether it is still letters alone once normalised: a mark at its end would join the stop's pre-token."""
    return head.isascii() or unicodedata.normalize("NFC", head).lower().isalpha()


def drops_space(path: str) -> bool:
    """Whether chunks between white space may be counted apart: known rules, no special string that holds white space, nothing around a text."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = t.get("pre_tokenizer") or {}
    plain = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not _SPACE.search(x["content"]) and not _WORD_AND_STOP.fullmatch(x["content"]) for x in t.get("added_tokens", []))
    return (t.get("normalizer"), pre.get("pretokenizers")) == SPACE_DROPPING and not t.get("post_processor") and plain


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8"))


class ChunkCounter:
    """Lengths of texts under one tokenizer; of chunks between white space where its rules allow that, else of whole texts."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda chunks: [len(x) for x in piece.encode(chunks, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._encode = lambda chunks: [len(e.ids) for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]
        self.by_chunk, self._kept_bytes = drops_space(path), 0
        self._kept: dict[str, int] = {"": 0}
        self._stop = {s: n for s, n in zip(".,;:!?", self._encode(list(".,;:!?")), strict=True)}

    def parts(self, text: str) -> Iterator[list[str]]:
        """What of a text is counted apart, in lists of about BATCH_BYTES characters at most where it may be cut."""
        if not self.by_chunk:
            yield [text]
            return
        for part in safe_parts(text):
            yield _SPACE.split(part) if "\r" in part else part.replace("\n", " ").replace("\t", " ").split(" ")

    def lengths(self, batch: list[list[str]]) -> list[int]:
        """The number of tokens of each list of chunks."""
        if not self.by_chunk:
            return [n for chunks in batch for n in self._encode(chunks)]
        kept = self._kept
        if self._kept_bytes > KEPT_BYTES:
            kept.clear()
            kept[""] = self._kept_bytes = 0
        missing = {c for chunks in batch for c in chunks if c not in kept}
        if missing:
            self._learn(missing)
            self._kept_bytes += sum(map(len, missing))
        return [sum(map(kept.__getitem__, chunks)) for chunks in batch]

    def _learn(self, chunks: set[str]) -> None:
        """A chunk of letters and one closing stop is two pre-tokens; the letters, case folded where that is ASCII's, are shared."""
        kept, split = self._kept, {}
        heads = set()
        for c in chunks:
            m = _WORD_AND_STOP.fullmatch(c)
            head, stop = m.groups() if m and _only_letters(m[1]) else (c, "")
            if head.isascii() and head.isalpha():
                head = head.lower()
            split[c] = head, stop
            if head not in kept:
                heads.add(head)
        todo, size = [], 0
        for h in sorted(heads, key=len):
            todo.append(h)
            size += n_bytes(h)
            if size >= BATCH_BYTES:
                kept.update(zip(todo, self._encode(todo), strict=True))
                todo, size = [], 0
        if todo:
            kept.update(zip(todo, self._encode(todo), strict=True))
        for c, (head, stop) in split.items():
            kept[c] = kept[head] + (self._stop[stop] if stop else 0)


_counters: dict[str, ChunkCounter] = {}


def counter(path: str) -> ChunkCounter:
    """One counter per worker process and tokenizer."""
    if path not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _counters[path] = ChunkCounter(path)
    return _counters[path]


def safe_parts(text: str, limit: int = BATCH_BYTES) -> Iterator[str]:
    """The text in parts of about limit characters that end at white space."""
    at = 0
    while len(text) - at > limit:
        m = _SPACE.search(text, at + limit)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit_tokens: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit_tokens) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in batches:
            ids, size, found = b.column(0), [], []
            group, owner, held = [], [], 0
            total = [0] * b.num_rows

            def flush():
                for row, n in zip(owner, count.lengths(group), strict=True):
                    total[row] += n
                group.clear()
                owner.clear()

            for row, value in enumerate(b.column(1)):
                text = value.as_py() or ""
                size.append(n_bytes(text))
                room = size[-1] / max(1, len(text))  # bytes a character
                for chunks in count.parts(text):
                    group.append(chunks)
                    owner.append(row)
                    held += int(min(len(text), BATCH_BYTES) * room)
                    if held >= BATCH_BYTES:
                        flush()
                        held = 0
            flush()
            found = total
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit_tokens)
