"""BPE encoding and decoding by a prefix-sharing traversal of a trie of words.

The distinct words of a batch go into a trie. A depth-first walk hands each node the last token of the
encoding of every shorter prefix on its path; a node's own last token is the one suffix token that may follow
the last token in front of it. So what words share at their start is encoded once. Two tokens may stand side
by side exactly if no merge crosses their border while both grow, which is remembered for each pair.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, load
from .token_counts import SPACE, byte_symbols

#: fixed values: the split pattern of the word-level pre-tokenizer
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


class TrieCodec:
    """Encodes and decodes under a BPE vocabulary with an end-of-word suffix. Remembers up to `most` words."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.made_of = {a + b: (a, b) for a, b in reversed(merges)}
        self.edges: tuple[dict, dict] = ({}, {})
        bodies = {t.removesuffix(self.end) for t in self.vocab}
        self.heads = {b[:i] for b in bodies for i in range(len(b) + 1)}
        self.states: dict[str, tuple] = {}
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.id_text = {t: str(i) for t, i in self.vocab.items()}
        self.to_symbol = dict(enumerate(byte_symbols()))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.most, self.beside = most, {}
        self.find = regex.compile(PRE_TOKEN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging, lowest rank first; used once for each token only."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def growth(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The symbols that stand at the token's right (left) edge while it is merged, each with the rank of
        the merge that ends it. Empty if merging its symbols does not give the token."""
        known = self.edges[right].get(token)
        if known is None:
            known = []
            if self.merged(self.symbols(token)) == [token]:
                edge, until = token, 1 << 60
                while True:
                    known.append((edge, until))
                    if edge not in self.made_of:
                        break
                    until = self.rank[self.made_of[edge]]
                    edge = self.made_of[edge][right]
                known.reverse()
            self.edges[right][token] = known
        return known

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging never crosses the border of the two tokens."""
        if len(self.beside) > 4 * self.most:
            self.beside.clear()
        a, b = self.growth(left, True) if left else [("", 1 << 60)], self.growth(right, False)
        i = j = 0
        fits = bool(a and b)
        while fits:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = self.rank.get((x, y), 1 << 61)
            if across < x_until and across <= y_until:
                fits = False
            elif i + 1 == len(a) and j + 1 == len(b):
                break
            elif x_until <= y_until:
                i += 1
            else:
                j += 1
        self.beside[(left, right)] = fits
        return fits

    def state(self, text: str) -> tuple:
        """What a node needs to know of its path: the longest end of it that a token starts with (text is cut
        down to that), the tokens that end here inside a word and at a word's end, longest first with the
        characters each covers, and the states that follow."""
        while text not in self.heads:
            text = text[1:]
        found = self.states.get(text)
        if found is None:
            inside = tuple((text[i:], len(text) - i) for i in range(len(text)) if text[i:] in self.vocab)
            at_end = tuple((text[i:] + self.end, len(text) - i) for i in range(len(text)) if text[i:] + self.end in self.vocab)
            found = self.states[text] = (text, inside, at_end, {})
        return found

    def learn(self, words: set[str]) -> None:
        """Encodes words that are new: a trie of them, walked depth first."""
        symbol, root = self.to_symbol, {}
        for word in words:  # a node is a dict from symbol to node; None holds the word that ends there
            node = root
            for b in word.encode():
                c = symbol[b]
                node = node.setdefault(c, {}) if c not in node else node[c]
            node[None] = word
        deepest = 1 + max((len(w.encode()) for w in words), default=0)
        last, covers = [""] * (deepest + 1), [0] * (deepest + 1)  # of the first i characters of the path: last token, its length
        beside, may_follow, id_text = self.beside, self.may_follow, self.id_text
        todo = [(1, c, self.state(""), n) for c, n in root.items()]
        while todo:
            depth, c, state, node = todo.pop()
            state = state[3].get(c) or state[3].setdefault(c, self.state(state[0] + c))
            word = node.pop(None, None)
            if word is not None:
                for token, n in state[2]:
                    left = last[depth - n]
                    fits = beside.get((left, token))
                    if fits or fits is None and may_follow(left, token):
                        break
                tokens, rest = [token], depth - n
                while rest:
                    tokens.append(last[rest])
                    rest -= covers[rest]
                tokens.reverse()
                self.ids[word] = " ".join([id_text[t] for t in tokens])
                self.decoded[word] = " ".join(tokens)
            if node:
                for token, n in state[1]:
                    left = last[depth - n]
                    fits = beside.get((left, token))
                    if fits or fits is None and may_follow(left, token):
                        break
                last[depth], covers[depth] = token, n
                depth += 1
                for c, n in node.items():
                    todo.append((depth, c, state, n))

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; special tokens stand as they are."""
        out: list[str] = []
        for i, part in enumerate(self.split(text) if "<|" in text else [text]):
            if i % 2:
                out.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            out += self.find(part)
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of tokens, ids joined by a space, decoded text."""
        if len(self.ids) > self.most:
            self.ids.clear()
            self.decoded.clear()
        for s, i in self.special.items():
            self.ids[s], self.decoded[s] = str(i), s
        pieces = [self.pieces(t) for t in texts]
        new: set[str] = set()
        for p in pieces:
            new.update(p)
        gc.disable()  # the trie is large and has no cycles
        self.learn(new - self.ids.keys())
        gc.enable()
        ids_of, decoded_of = self.ids.__getitem__, self.decoded.__getitem__
        out = []
        for p in pieces:
            ids = " ".join(map(ids_of, p))
            out.append((ids.count(" ") + 1 if p else 0, ids, " ".join(map(decoded_of, p))))
        return out


@lru_cache(2)
def codec(path: str) -> TrieCodec:
    return TrieCodec(path)


def encode_decode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_texts: bool = False
) -> DataFrame:
    """Encodes every row's text and decodes the ids again.

    Returns id_col, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the
    decoded text in UTF-8); with_texts adds ids (array of int) and decoded (string). One pass, no shuffle.

    tokenizer: path of a BPE tokenizer file with an end-of-word suffix that every executor can read. Strings
    of its special tokens inside a text are those tokens. A null or empty text has no ids; null ids of rows
    and repeated rows pass through; an empty table gives no rows; extra columns are ignored. Texts are taken whole; an
    unbroken word of a million characters takes about 5 seconds and 250 MB.
    """

    def run(batches):
        words = codec(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                rows = words.encode(texts[a:b])
                arrays = [
                    batch.column(0).slice(a, b - a),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string()),
                ]
                if with_texts:
                    arrays += [pa.array([[int(i) for i in r[1].split()] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    more = [("ids", "array<int>"), ("decoded", "string")] if with_texts else []
    columns = [("id", "long"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *more]
    names = [c for c, _ in columns]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in columns)).withColumnRenamed("id", id_col)


def op3(spark, sf_dir):
    import public_tokenizers

    return encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
