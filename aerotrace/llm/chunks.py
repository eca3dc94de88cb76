"""Tables of distinct chunks: each distinct word of a run of texts is tokenized once."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Entries kept per worker; a full table is emptied, which costs time but changes no result.
LIMIT = 1_500_000
PIECE_LIMIT = 300_000
BLOCK_WORDS = 4_096
RUN_CHARS = 4_000_000  # of texts encoded together, unless one is longer
SHORT_LIMIT = 300_000
# The byte-level pre-tokenizer, of which a run of letters, of digits or of signs is one pre-token
# if no apostrophe is near (letters only to U+024F, which all versions of Unicode agree on), and how it
# writes a space and a line break.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
RUN = re.compile(f"[{LETTERS}]+|[0-9]+|[{SIGNS}]+")
RUNS = re.compile(f"\n?[{LETTERS}0-9{SIGNS}]+")
SPACE, BREAK = "\u0120", "\u010a"
_BY_MODEL: dict[tuple[str, int], object] = {}


def for_worker(kind: type, model: bytes):
    """The encoder of this Python worker for a model; tasks of one worker share its table."""
    key = (kind.__name__, hash(model))
    if key not in _BY_MODEL:
        _BY_MODEL[key] = kind(model)
    return _BY_MODEL[key]


class ByteBpe:
    """Ids of the ``tokenizers`` library for a byte-level BPE file, without special tokens added.

    A text is cut before every space and line break. Such a cut lies between two pre-tokens if
    it stands between characters that are no white space, so the parts can be encoded one by one.
    Words for which that is not certain (next to more white space, or with the text of a special
    token) have no entry, and a text with one of them is encoded whole.
    """

    def __init__(self, model: bytes) -> None:
        from tokenizers import Tokenizer

        vocab = json.loads(model)
        self.special = [t["content"] for t in vocab["added_tokens"]]
        lengths = {i: len(piece) for piece, i in vocab["model"]["vocab"].items()}  # a letter stands for a byte
        self.model = Tokenizer.from_str(model.decode())
        self.model.model._resize_cache(0)  # the tables below are the cache
        size = max(max(lengths) + 1, self.model.get_vocab_size())
        self.length = np.zeros(size, dtype=np.int64)
        self.length[list(lengths)] = list(lengths.values())
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.raw = [i.to_bytes(self.kind.itemsize, "little") for i in range(size)]
        self.bpe = self.model.model
        self.by_runs = vocab["normalizer"] is None and vocab["pre_tokenizer"] == BYTE_LEVEL
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}
        del vocab
        self.short: dict[str, bytes] = {}
        self.first: dict[str, bytes | None] = {}
        self.rest: dict[str, bytes | None] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        done = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in done]

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token in the letters that stand for bytes."""
        raw = self.raw
        return b"".join([raw[t.id] for t in self.bpe.tokenize(piece)])

    def _by_runs(self, word: str) -> bytes:
        """Ids of a word of ``RUNS`` alone: each run is one pre-token, the first with the space before it."""
        lead, runs = ("", [BREAK, *RUN.findall(word[1:])]) if word[0] == "\n" else (SPACE, RUN.findall(word))
        if not word.isascii():
            runs = [r if r.isascii() or r == BREAK else "".join([self.letters[b] for b in r.encode()]) for r in runs]
        if len(runs) == 1:
            return self._piece(lead + runs[0])
        short, out = self.short, []
        for piece in (lead + runs[0], *runs[1:]):
            ids = short.get(piece)
            if ids is None:
                if len(short) > SHORT_LIMIT:
                    short.clear()
                ids = short[piece] = self._piece(piece)
            out.append(ids)
        return b"".join(out)

    def _learn(self, words: list[str]) -> None:
        """Entries of words. Those of plain runs of letters, digits or signs go to the library's model
        run by run. Many others are encoded as one text; their ids are told apart by their bytes."""
        table, plain = self.rest, []
        marked = {w for s in self.special for w in words if s in w}
        for w in words:
            if self.by_runs and RUNS.fullmatch(w) and w not in marked:
                table[w] = self._by_runs(w)
                continue
            core = w[1:] if w[:1] == "\n" else w
            if core and core.strip() == core:
                plain.append(w)
            else:
                table[w] = None
        for at in range(0, len(plain), BLOCK_WORDS):
            block = plain[at : at + BLOCK_WORDS]
            text = "".join([w if w[0] == "\n" else " " + w for w in block])
            if any(s in text for s in self.special):
                table.update((w, None) for w in block if any(s in w for s in self.special))
                block = [w for w in block if w not in table]
                text = "".join([w if w[0] == "\n" else " " + w for w in block])
            ids = np.array(
                self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind
            )
            sizes = [len(w) for w in block] if text.isascii() else [len(w.encode()) for w in block]
            ends = np.cumsum([n if w[0] == "\n" else n + 1 for n, w in zip(sizes, block, strict=True)])
            upto = np.cumsum(self.length[ids])
            cuts = np.searchsorted(upto, ends) + 1
            if not (cuts <= len(ids)).all() or not (upto[np.minimum(cuts, len(ids)) - 1] == ends).all():
                table.update((w, None) for w in block)  # the words of such a text are encoded with it
                continue
            raw, marks = ids.tobytes(), (cuts * self.kind.itemsize).tolist()
            table.update(zip(block, (raw[i:j] for i, j in zip([0, *marks], marks, strict=False)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian integers of ``kind``."""
        out, run, size = [], [], 0
        for text in texts:
            if run and size + len(text) > RUN_CHARS:
                out += self._encode(run)
                run, size = [], 0
            run.append(text)
            size += len(text)
        return out + self._encode(run) if run else out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text of a run. The distinct words of the run are looked up, each once, and
        their ids dealt to all places of the words as arrays."""
        if len(self.rest) > LIMIT:
            self.rest.clear()
            self.first.clear()
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        starts = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)

        firsts, nth = np.unique(at[starts[:-1]], return_inverse=True)
        heads = [words[i] for i in firsts.tolist()]
        new = [h for h in heads if h not in self.first]
        sure = [h for h in new if h.strip() == h and not any(s in h for s in self.special)]
        self.first.update((h, None) for h in new)
        self.first.update(zip(sure, self._whole(sure), strict=True))

        at[starts[:-1]] = len(words) + nth
        inside = np.zeros(len(words) + len(heads), dtype=bool)
        inside[at] = True  # but for words that only begin texts
        table = self.rest
        ids = list(map(table.get, words))
        new = [i for i, v in enumerate(ids) if v is None and inside[i]]
        self._learn([w for i in new if (w := words[i]) not in table])
        for i in new:
            ids[i] = table[words[i]]
        ids += map(self.first.get, heads)

        unsure = np.zeros(len(ids), dtype=bool)
        unsure[[i for i, v in enumerate(ids) if v is None and inside[i]]] = True
        whole = np.logical_or.reduceat(unsure[at], starts[:-1])
        ids = [i or b"" for i in ids]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(ids), dtype=self.kind)
        counts = n[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat((np.cumsum(n) - n)[at] - upto[:-1], counts)
        places += np.arange(upto[-1])
        dealt, cuts = flat[places], upto[starts].tolist()
        return [
            self._whole([text])[0] if all_ else dealt[i:j].tobytes()
            for text, all_, i, j in zip(texts, whole.tolist(), cuts, cuts[1:], strict=False)
        ]


class Pieces:
    """Ids and decoded text of the ``sentencepiece`` library for a model file.

    Needs a model in which no piece holds the white space marker after another character, that
    puts one marker before the text and changes no characters (checked on loading); other models
    are used on whole texts. Then a marked word is segmented in the same way wherever it stands.
    Texts with runs of spaces, with a space at an end, or with the marker itself are encoded whole.
    """

    MARK = "▁"

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = (
            not any(self.MARK in p.lstrip(self.MARK) for p in pieces)
            and self.model.normalize(" a  bé́ ") == f"{self.MARK * 2}a{self.MARK * 2}bé́{self.MARK}"
        )
        self.table: dict[str, bytes] = {}
        self.changed: dict[str, str] = {}  # words that do not decode to themselves

    def _learn(self, words: list[str]) -> None:
        ids = self.model.encode(words, num_threads=1)
        for word, i, back in zip(words, ids, self.model.decode(ids, num_threads=1), strict=True):
            self.table[word] = np.array(i, dtype="<i4").tobytes()
            if back != word:
                self.changed[word] = back

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids of each text as little-endian 32-bit integers, and the text they decode to."""
        if len(self.table) > PIECE_LIMIT:
            self.table.clear()
            self.changed.clear()
        split = [t.split(" ") if self.by_word and self.MARK not in t else [""] for t in texts]
        new = set().union(*split) - self.table.keys() - {""}
        if new:
            self._learn(list(new))
        ids, decoded = [], []
        for text, words in zip(texts, split, strict=True):
            if not text:
                ids.append(b"")
                decoded.append("")
            elif "" in words:
                whole = self.model.encode(text)
                ids.append(np.array(whole, dtype="<i4").tobytes())
                decoded.append(self.model.decode(whole))
            else:
                ids.append(b"".join([self.table[w] for w in words]))
                if self.changed and not self.changed.keys().isdisjoint(words):
                    text = " ".join([self.changed.get(w, w) for w in words])
                decoded.append(text)
        return ids, decoded
