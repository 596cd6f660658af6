"""Token counts with the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.tables import kept_in_worker

#: Fixed values of the tokenizer file: how it cuts pre-tokens, and its white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: The shortcut takes texts of these characters only: each is its own canonical composition, and Python and the library
#: lower-case and classify them alike (proved at load time, character by character).
PLAIN = r"\x00-ɏ‐-‧‰-⁞₠-₿"


#: Characters of text that are counted at a time.
GROUP = 1 << 21


class Counter:
    """Counts the tokens of texts as the tokenizer file's library does.

    At load time every vocabulary string that closes a word is encoded alone; those that give exactly one token form the
    set `whole`. A pre-token in that set counts 1 without merging. Any other pre-token is merged by the library,
    once, and remembered in a table of at most `most` strings and about 16 * `most` characters. A text with a character outside PLAIN, or with a
    special token's string, goes to the library as a whole.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        chars = [chr(c) for a, b in ((0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)) for c in range(a, b + 1)]
        cut, normal = regex.compile(PRE_TOKEN), self.library.normalizer.normalize_str
        odd = [c for c in chars if self._cuts(normal(c)) != cut.findall(c.lower())]
        self.cut = cut
        self.other = regex.compile("|".join([f"[^{PLAIN}]", *map(regex.escape, [*odd, *special])]))
        words = [w[: -len("</w>")] for w in self.library.get_vocab() if w.endswith("</w>")]
        byte = {c: b for b, c in self._byte_letters().items()}
        texts = []
        for w in words:
            try:
                texts.append(bytes(byte[c] for c in w).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        alone = self.library.encode_batch(texts, add_special_tokens=False)
        whole = {t for t, e in zip(texts, alone, strict=True) if len(e.ids) == 1 and cut.fullmatch(t) and t == t.lower()}
        vocab = self.library.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.base = dict.fromkeys(whole, 1)
        self.known, self.size = dict(self.base), 0

    def _cuts(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """How byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def merge(self, pieces: list[str]) -> None:
        """Counts of pre-tokens that are not known, from one call: a token that closes a word ends its pre-token."""
        ids = np.array(self.library.encode(" ".join(pieces), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.closes[ids])
        self.known.update(zip(pieces, np.diff(ends, prepend=-1).tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        cuts = [None if self.other.search(t) else self.cut.findall(t.lower()) for t in texts]
        new = set().union(*filter(None, cuts)).difference(self.known)
        self.size += sum(map(len, new))
        if len(self.known) + len(new) > self.most or self.size > 16 * self.most:
            self.known, self.size = dict(self.base), 0
            new = set().union(*filter(None, cuts)).difference(self.known)
        if new:
            self.merge(list(new))
        known = self.known.__getitem__
        return [len(self.library.encode(t, add_special_tokens=False).ids) if c is None else sum(map(known, c)) for t, c in zip(texts, cuts, strict=True)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    Counts are the library's for the whole text, however long, without special tokens around it. Null counts as empty (0 tokens);
    repeated rows count each; an empty table gives an empty result; other columns are ignored. Scan and count only: no shuffle.
    `tokenizer_path` is read where the tasks run, so it must exist there.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or kept_in_worker(f"tokens {tokenizer_path}", lambda: Counter(tokenizer_path))
            n, group, size = [], [], 0
            for value in batch.column(1):
                text = value.as_py() or ""
                group.append(text)
                size += len(text)
                if size > GROUP:
                    n += counter.counts(group)
                    group, size = [], 0
            n = pa.array(n + counter.counts(group), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(counts, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
