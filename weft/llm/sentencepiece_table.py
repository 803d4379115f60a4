"""SentencePiece (BPE) encoding by a table of last tokens, and decoding.

For every prefix of a piece of text there is exactly one last token in the encoding of that prefix.
An automaton over the vocabulary finds the tokens that end at each place; a token is the last one if
it starts the text or is compatible with the last token of the prefix before it, that is if the two
side by side are what the merges would leave of their joined text. The ids are then read backwards
through the table. Work is linear in the text; nothing but runs of word-start marks is merged at run time.

Compatibility: every token has one last merge (left part, right part). Undoing the later merge of
the two tokens, step by step, shows the parts that met at the border and when; had they formed a
piece earlier than the merge just undone, the pair could not have stayed apart. Equal merges run
from left to right.

No piece holds a word-start mark behind another character, nor any unknown character, and in most
vocabularies none goes on from a letter to another sign, so texts are cut there first and the ids of
recent cuts are remembered in a bounded table. Pieces of word-start marks alone share one score below
all others, so compatibility of two doesn't follow from their parts: runs of marks are merged last, from
the left, on a heap, and results for runs of up to 4,096 are remembered.

Defined cases: null text is the empty text (only the end id); null ids stay null; repeated rows each
get a row; empty tables give empty results; extra columns are ignored; very long texts are taken whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._common import bounded_batches, kept_by_worker, text_of
from weft.llm.token_counts import grouped

MARK = "▁"
MEMO_ENTRIES, MEMO_KEY_CHARS, PAIR_ENTRIES = 500_000, 48, 2_000_000


class PieceTable:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or not norm.escape_whitespaces or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with identity normalisation and word-start marks is needed")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.dummy_prefix, self.byte_fallback = norm.add_dummy_prefix, train.byte_fallback
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.unk = next(i for i, t in enumerate(self.types) if t == 2)
        self.eos = next((i for i, p in enumerate(self.pieces) if p == (train.eos_piece or "</s>")), -1)
        self.unk_surface = train.unk_surface
        self.byte_id = {int(p[3:-1], 16): i for i, p in enumerate(self.pieces) if self.types[i] == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}

        normal = {p: i for i, p in enumerate(self.pieces) if self.types[i] == 1}
        self.runs = {len(p): i for p, i in normal.items() if set(p) == {MARK}}
        run_scores = {model.pieces[i].score for n, i in self.runs.items() if n > 1}
        words = {p: i for p, i in normal.items() if len(p) > 1 and set(p) != {MARK}}
        if any(MARK in p[1:] for p in words) or len(run_scores) > 1:
            raise ValueError("pieces with a word-start mark inside are not handled")
        if run_scores and words and min(run_scores) >= min(model.pieces[i].score for i in words.values()):
            raise ValueError("runs of word-start marks must merge last")
        #: Times of the merges: higher scores first.
        order = sorted(words.values(), key=lambda i: (-model.pieces[i].score, i))
        self.time = {i: n for n, i in enumerate(order)}
        #: Every character of a piece is a token; those that are no piece get numbers past the vocabulary.
        letters = {c for p in words for c in p} | {p for p in normal if len(p) == 1}
        self.token = dict(words)
        self.extra: list[str] = []
        for c in sorted(letters):
            if c in normal:
                self.token[c] = normal[c]
            else:
                self.token[c] = len(self.pieces) + len(self.extra)
                self.extra.append(c)
        self.parts: dict[int, tuple[int, int]] = {}
        self.text = {i: p for p, i in self.token.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self._learn_parts(words)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.token.items():
            if len(p) == 1 or i in self.parts:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.cut = self._cutter(letters - {MARK})
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.run_memo: dict[int, tuple[int, ...]] = {}
        self.shown = [self._shown(i) for i in range(len(self.pieces))]
        self.starts = [p.startswith(MARK) for p in self.pieces]
        self.hard = frozenset(self.byte_of) | {self.unk}

    def _cutter(self, known: set[str]) -> re.Pattern:
        """Cuts before word-start marks, at unknown characters and, if no piece goes on past one, after words."""
        word = {c for c in known if c.isalpha()}
        listed = lambda chars: "[" + re.escape("".join(sorted(chars))) + "]"
        if not word or word == known or any(a in word and b not in word for p in self.token for a, b in zip(p, p[1:])):
            return re.compile(f"{MARK}*{listed(known)}+|{MARK}+|[^{MARK}]")
        rest = listed(known - word)
        return re.compile(f"{MARK}*{rest}*{listed(word)}+|{MARK}*{rest}+|{MARK}+|[^{MARK}]")

    def _learn_parts(self, words: dict[str, int]) -> None:
        """The last merge of each piece, by merging it alone; pieces that merging never makes have none."""
        token, time = self.token, self.time
        for piece, number in words.items():
            row = list(piece)
            while len(row) > 2:
                best = min(((time[token[a + b]], n) for n, (a, b) in enumerate(zip(row, row[1:])) if token.get(a + b) in time), default=None)
                if best is None:
                    break
                n = best[1]
                row[n : n + 2] = [row[n] + row[n + 1]]
            if len(row) == 2:
                self.parts[number] = (token[row[0]], token[row[1]])

    def _meet(self, a: int, b: int) -> int:
        """When the two tokens side by side would merge; a number past all times if never."""
        key = (a, b)
        if key not in self.joined:
            if len(self.joined) > PAIR_ENTRIES:
                self.joined.clear()
            self.joined[key] = self.time.get(self.token.get(self.text[a] + self.text[b], -1), 1 << 60)
        return self.joined[key]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' joined text is just these two tokens."""
        parts, time = self.parts, self.time
        before = 1 << 60
        while True:
            if self._meet(a, b) < before:
                return False
            made_a, made_b = time[a] if a in parts else -1, time[b] if b in parts else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:  # the left one came later: a merge at its time at the border comes after it
                before, a = made_a, parts[a][1]
            else:
                before, b = made_b + 1, parts[b][0]

    def _word(self, text: str) -> list[int]:
        """Tokens of a text of known characters without inner word-start marks."""
        last, size = [-1] * len(text), [0] * len(text)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(text):
            if size[end]:
                continue
            if n <= end:
                key = last[end - n] << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > PAIR_ENTRIES:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(last[end - n], token)
                if not fits:
                    continue
            last[end], size[end] = token, n
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _run(self, n: int) -> tuple[int, ...]:
        """Ids of n word-start marks that nothing else takes: equal merges, the leftmost first."""
        if n <= 1:
            return (self.runs[1],) * n if 1 in self.runs else self._bytes(MARK) * n
        if n in self.run_memo:
            return self.run_memo[n]
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(i, 1, 1) for i in range(n - 1)] if 2 in self.runs else []
        while heap:
            i, a, b = heapq.heappop(heap)
            j = after[i]
            if size[i] != a or j >= n or size[j] != b or a + b not in self.runs:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
                heapq.heappush(heap, (i, size[i], size[after[i]]))
            if before[i] >= 0:
                heapq.heappush(heap, (before[i], size[before[i]], size[i]))
        out = tuple(self.runs[s] for s in size if s)
        if n <= 4096:
            self.run_memo[n] = out
        return out

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in char.encode()) if self.byte_fallback else (self.unk,)

    def _cut_ids(self, piece: str) -> tuple[int, ...]:
        body = piece.lstrip(MARK)
        marks = len(piece) - len(body)
        if not body:
            return self._run(marks)
        if body[0] not in self.token:
            return self._bytes(body)
        tokens = self._word(MARK + body if marks else body)
        if marks and self.text[tokens[0]] == MARK:
            head, tokens = self._run(marks), tokens[1:]
        else:
            head = self._run(marks - 1) if marks else ()
        if not self.extra:
            return (*head, *tokens)
        size = len(self.pieces)
        return (*head, *chain.from_iterable((t,) if t < size else self._bytes(self.text[t]) for t in tokens))

    def cuts(self, text: str) -> list[tuple[int, ...]]:
        """The ids of the text, by independent cuts of it."""
        if not text:
            return []
        escaped = text.replace(" ", MARK)
        parts = self.cut.findall(MARK + escaped if self.dummy_prefix else escaped)
        memo = self.memo
        try:
            return list(map(memo.__getitem__, parts))
        except KeyError:
            pass
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        long = {}
        for p in parts:
            if p not in memo and p not in long:
                (memo if len(p) <= MEMO_KEY_CHARS else long)[p] = self._cut_ids(p)
        return [memo[p] if p in memo else long[p] for p in parts]

    def encode(self, text: str, end: bool = False) -> list[int]:
        ids = list(chain.from_iterable(self.cuts(text)))
        if end:
            ids.append(self.eos)
        return ids

    def _shown(self, i: int) -> str:
        if self.types[i] == 3:
            return ""
        return self.unk_surface if i == self.unk else self.pieces[i].replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, as the library gives it: one leading blank goes, broken bytes become U+FFFD."""
        types = self.types
        lead = 0
        for i in ids:  # the blank that encoding put first
            if types[i] != 3:
                lead = int(self.dummy_prefix and types[i] == 1 and self.starts[i])
                break
        if self.hard.isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))[lead:]
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_text(held))
                held = bytearray()
            out.append(self.shown[i])
        out.append(_text(held))
        return "".join(out)[lead:]


def _text(data: bytearray) -> str:
    """UTF-8 with U+FFFD for each byte that fits no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            at += n
        return "".join(out)


def piece_table(path: str) -> PieceTable:
    return kept_by_worker(f"pieces of {path}", lambda: PieceTable(path))


def encode_texts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text with the end id."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        table = piece_table(model_path)
        return pa.array([table.encode(t, True) for t in text.to_pylist()], pa.list_(pa.int32()))

    return docs.select(F.col(id_col), ids(text_of(text_col)).alias("ids"))


def decode_ids(rows: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each array of ids; null ids give null."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        table = piece_table(model_path)
        return pa.array([None if x is None else table.decode(x) for x in ids.to_pylist()], pa.string())

    return rows.select(F.col(id_col), text(F.col(ids_col)).alias("text"))


def encode_digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and decoded again in one pass."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digests(text: pa.Array) -> pa.Array:
        table = piece_table(model_path)
        count, first, second = [], [], []
        for group in grouped(text.cast(pa.binary()).to_pylist()):
            for raw in group:
                ids = table.encode(raw.decode(), True)
                count.append(len(ids))
                first.append(hashlib.sha256(" ".join(map(_decimal, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(count, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]
        )

    return docs.select(F.col(id_col), digests(text_of(text_col)).alias("d")).select(id_col, "d.*")


class _Decimals(dict):
    def __missing__(self, i: int) -> str:
        self[i] = s = str(i)
        return s


_decimal = _Decimals().__getitem__
