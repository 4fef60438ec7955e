"""A piece vocabulary: streaming search for encoding, and a counting transducer.

A BPE encoding of a prefix is the one chain of pieces in which every neighbouring pair is compatible (encoding the two
pieces' text alone gives back the two pieces). So encoding is a Viterbi search with backpointers in which a boundary has
one surviving path: Pieces.stream walks the boundaries, keeps those since the last commit, and commits ids whenever the
backpointer paths of all boundaries that can still be extended converge on one.

Counter is the same search as a deterministic transducer. Its state has, for every boundary a piece may still extend,
the place in the piece trie, the last piece, and how many tokens more than the least it has; the common part is the
count that the transition emits. States and transitions are compiled when first met. A stretch of text is a map from
state to (state, count), and maps compose. After a step from text to space, and around a line end, the state is always
the same: a stretch with such a reset maps all states to one, but for the count of what comes before its first reset.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import sentencepiece

SPACE = "▁"
NEVER = float("inf")
#: Bounds of what one Python worker remembers; beyond them it starts afresh, results stay the same.
MAX_TRANSITIONS = 1_000_000
MAX_WORDS = 400_000
MAX_PAIRS = 2_000_000
LONGEST_KEPT = 64
#: Characters of a run that the search takes in at once, besides its window.
STEP = 256

_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The pieces of a vocabulary file, one per Python worker."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


class Pieces:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(self.pieces))]
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.rank = {p: -model.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.unknown = model.unk_id()
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.longest = 1
        for i, p in enumerate(self.pieces):
            if p not in self.rank or special[i]:
                continue
            self.longest = max(self.longest, len(p))
            node = 0
            for ch in p:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][ch]
            self.ends[node] = i
        #: Runs between resets. Where a piece has a space only at its start, every step from text to space is one.
        splits = not any(SPACE in p.lstrip(SPACE) for p in self.rank) and "\n" not in self.children[0]
        self.runs = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if splits else "(?s).+")
        self.as_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] and i != self.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.pairs: dict[int, bool] = {}
        self.history: dict[int, list] = {}

    def merges(self, piece: int) -> list[tuple[float, str, str]]:
        """Plain BPE of one piece's text, best-ranked neighbours first: rank, first and last part after each merge."""
        found = self.history.get(piece)
        if found is None:
            parts, found = list(self.pieces[piece]), []
            while len(parts) > 1:
                rank, k = min((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                found.append((rank, parts[0], parts[-1]))
            self.history[piece] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the text of both pieces gives them back: no merge reaches across before they are whole.

        Up to such a merge the two texts merge independently, so their own merges are replayed in order of rank; of
        equal ranks the leftmost goes first.
        """
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            x, y, rank = self.merges(a), self.merges(b), self.rank
            i = j = 0
            right, left = self.pieces[a][-1], self.pieces[b][0]
            while True:
                across = rank.get(right + left, NEVER)
                own_a, own_b = x[i][0] if i < len(x) else NEVER, y[j][0] if j < len(y) else NEVER
                if across < own_a and across <= own_b:
                    found = False
                    break
                if own_a == own_b == NEVER:
                    found = True
                    break
                if own_a <= own_b:
                    right = x[i][2]
                    i += 1
                else:
                    left = y[j][1]
                    j += 1
            self.pairs[key] = found
        return found

    def spelled(self, text: str) -> str:
        """As the search reads a text: spaces marked, one in front."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def raw(self, ch: str) -> list[int]:
        """The ids of a character that no piece has: its bytes, which nothing reaches across."""
        return [self.bytes_at.get(x, self.unknown) for x in ch.encode("utf-8", "surrogatepass")]

    def stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids of a spelled text that comes in chunks, each emitted once all surviving paths agree on it."""
        children, ends, pairs, longest = self.children, self.ends, self.pairs, self.longest
        # text from the last commit on; for each boundary in it the last piece (-2: bytes) and where that begins
        text, last, back, start, check = "", [-1], [0], 0, 2 * longest
        chunks = iter(chunks)
        more = True
        while more:
            chunk = next(chunks, None)
            more = chunk is not None
            text += chunk or ""
            last += [-1] * (len(chunk or ""))
            back += [0] * (len(chunk or ""))
            size = len(text)
            until = size - longest if more else size
            while start < until:
                before, node, at = last[start], 0, start
                while at < size:
                    node = children[node].get(text[at])
                    if node is None:
                        break
                    at += 1
                    piece = ends[node]
                    if piece >= 0 and last[at] == -1:
                        if before >= 0:
                            fits = pairs.get(before << 20 | piece)
                            if fits is None:
                                fits = self.compatible(before, piece)
                            if not fits:
                                continue
                        last[at], back[at] = piece, start
                if at == start:
                    last[at + 1], back[at + 1] = -2, start
                start += 1
                if start >= check:
                    sure = self._converged(last, back, start)
                    if sure:
                        yield from self._path(text, last, back, sure)
                        text, last, back, start = text[sure:], last[sure:], back[sure:], start - sure
                        back = [b - sure for b in back]
                        size, until = len(text), until - sure
                    check = start + 2 * longest
        yield from self._path(text, last, back, len(text))

    def _converged(self, last: list[int], back: list[int], start: int) -> int:
        """The boundary where the paths of all boundaries that can still be extended meet."""
        reached = {start, *(b for b in range(start + 1, min(start + self.longest, len(last) - 1) + 1) if last[b] != -1)}
        while len(reached) > 1:
            late = max(reached)
            reached.remove(late)
            reached.add(back[late])
        return reached.pop()

    def _path(self, text: str, last: list[int], back: list[int], at: int) -> list[int]:
        """The ids from the last commit up to a boundary, along its backpointers."""
        out: list[int] = []
        while at > 0:
            out.extend([last[at]] if last[at] >= 0 else reversed(self.raw(text[at - 1])))
            at = back[at]
        out.reverse()
        return out

    def decode(self, ids) -> str:
        """The text of ids: bytes joined, the space in front (from encoding) taken away."""
        return b"".join(map(self.as_bytes.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


class Encoded(dict):
    """Ids of runs between resets, found by the streaming search and remembered."""

    def __init__(self, model: Pieces, value=list):
        super().__init__()
        self.model, self.value = model, value

    def __missing__(self, run: str):
        steps = [run] if len(run) <= STEP else (run[k : k + STEP] for k in range(0, len(run), STEP))
        found = self.value(self.model.stream(steps))
        if len(run) <= LONGEST_KEPT:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[run] = found
        return found

    def of(self, text: str) -> list:
        """The values of the runs of a text, in order."""
        return list(map(self.__getitem__, self.model.runs.findall(self.model.spelled(text))))


#: A state: for each boundary still to be extended, oldest first, its place in the trie, last piece, tokens above the least.
State = tuple[tuple[int, int, int], ...]
START: State = ((0, -1, 0),)


@dataclass(frozen=True)
class Stretch:
    """The map of a stretch of text from state to (state, count).

    head is what comes before the first reset, in pieces. Without a reset state is None, and the map is that of head. With
    one, any state goes to `state`, and count is what is emitted from the reset on.
    """

    head: tuple[str, ...]
    count: int = 0
    state: State | None = None


class Counter:
    """The counting transducer, compiled as far as texts have needed it."""

    def __init__(self, model: Pieces):
        self.model = model
        self.words: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[State, int] = {}
        self.states: list[State] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.known = 0
        self.number(START)

    def number(self, state: State) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return found

    def step(self, number: int, ch: str) -> tuple[int, int]:
        """Compiles one transition: the next state, and how many tokens it emits."""
        model, live = self.model, self.states[number]
        if ch not in model.children[0]:
            moved = [(0, -1, live[-1][2] + len(model.raw(ch)))]
        else:
            moved, best = [], None
            for node, last, count in live:
                child = model.children[node].get(ch)
                if child is None:
                    continue
                piece = model.ends[child]
                if best is None and piece >= 0 and (last < 0 or model.compatible(last, piece)):
                    best = (0, piece, count + 1)
                if model.children[child]:
                    moved.append((child, last, count))
            moved.append(best)
        least = min(count for _, _, count in moved)
        self.known += 1
        found = self.steps[number][ch] = (self.number(tuple((node, last, count - least) for node, last, count in moved)), least)
        return found

    def walk(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text, and the tokens emitted on the way."""
        if self.known > MAX_TRANSITIONS:
            self._forget()
        at, total, steps = self.number(state), 0, self.steps
        for ch in text:
            at, count = steps[at].get(ch) or self.step(at, ch)
            total += count
            if self.known > 2 * MAX_TRANSITIONS:
                state = self.states[at]
                self._forget()
                at, steps = self.number(state), self.steps
        return self.states[at], total

    def whole(self, run: str) -> int:
        """The tokens of a run between two resets: one transition from the start state to itself, remembered."""
        found = self.words.get(run)
        if found is None:
            state, count = self.walk(START, run)
            found = count + state[-1][2]
            if len(run) <= LONGEST_KEPT:
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[run] = found
        return found

    def stretch(self, text: str) -> Stretch:
        """The map of a piece of spelled text, cut anywhere."""
        runs = self.model.runs.findall(text)
        if len(runs) < 2:
            return Stretch((text,))
        words = self.words
        middle = sum([words[r] if r in words else self.whole(r) for r in runs[1:-1]])
        state, count = self.walk(START, runs[-1])
        return Stretch((runs[0],), middle + count, state)

    def walk_all(self, state: State, pieces: tuple[str, ...]) -> tuple[State, int]:
        """The state after a text in pieces, and the tokens emitted on the way."""
        total = 0
        for piece in pieces:
            state, count = self.walk(state, piece)
            total += count
        return state, total

    def compose(self, a: Stretch, b: Stretch) -> Stretch:
        """First a, then b; associative."""
        if a.state is None:
            return Stretch(a.head + b.head, b.count, b.state)
        state, count = self.walk_all(a.state, b.head)
        if b.state is None:
            return Stretch(a.head, a.count + count, state)
        return Stretch(a.head, a.count + count + state[-1][2] + b.count, b.state)

    def scan(self, maps: list[Stretch]) -> list[Stretch]:
        """All prefixes of a row of maps, in a tree of depth log2: neighbours first, then pairs, then the gaps."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        out = [maps[0]]
        for k in range(1, len(maps)):
            out.append(pairs[k // 2] if k % 2 else self.compose(pairs[k // 2 - 1], maps[k]))
        return out

    def last(self, maps: list[Stretch]) -> Stretch:
        """The last prefix alone: the way up of the scan's tree, which holds each piece of text once."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def total(self, whole: Stretch) -> int:
        """The tokens of a text from its map."""
        state, count = self.walk_all(START, whole.head)
        if whole.state is None:
            return count + state[-1][2]
        return count + state[-1][2] + whole.count + whole.state[-1][2]

    def count(self, text: str, chunk: int) -> int:
        """The tokens of a text: maps of its chunks, composed."""
        spelled = self.model.spelled(text)
        maps = [self.stretch(spelled[k : k + chunk]) for k in range(0, len(spelled), chunk)]
        return self.total(self.last(maps)) if maps else 0
