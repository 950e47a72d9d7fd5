"""Secret scans: patterns, and a linear-chain conditional random field that tags tokens.

Three patterns give base spans. The field tags each token as the begin of a secret, inside one, or outside, and
adds spans that overlap no base span. A token's features are its shape, its length, how its characters mix, the
words or shapes of up to three tokens before it and one behind it, and features of the whole file (length,
lines, share of digits). Tags are decoded by Viterbi.

A token whose score for "outside" beats the others by more than any change of its two transitions can win back
is outside on every best path, so Viterbi runs only over the stretches between such tokens, with equal results.
Chunks of text whose tokens beat them by so much more that no plain chunk near them and no file feature can
change it are plain; a text of plain chunks has no secrets and needs no scores.

The field learns from the base spans of a bounded sample, about ``SAMPLE_ROWS`` documents chosen by a hash:
windows around spans and some windows of other documents, at most ``WINDOWS`` of each document. Training is
full-batch gradient ascent of the penalised likelihood; nothing else reaches the driver.

Defined cases: null and empty texts have no spans; repeated rows are rows; without any base span in the sample
the field adds nothing; an empty table gives an empty result; columns other than doc_id and text are not read,
and ``redacted`` keeps all columns of its input.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.texts import computed
from tokenledger.session import written

SAMPLE_ROWS = 20_000
# Windows of one document, tokens on each side of a span, and one in how many documents shows ordinary text.
WINDOWS, AROUND, ORDINARY = 4, 12, 4
STEPS, LEARNING_RATE, PENALTY = 80, 0.15, 2e-5
# Chunks of text that a worker remembers before it forgets them all.
REMEMBERED = 200_000

BEGIN, INSIDE, OUTSIDE = range(3)
MASK = "[SECRET]"
KINDS = ("assign", "access", "hex", "crf")

# The base patterns and the least length of what they find.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
# What any assignment holds, to pass by other texts quickly.
_KEYWORDS = ("passw", "secret", "token", "api")

_TOKEN = re.compile(r"[^\W_]+(?:[+/_.~-]+[^\W_]+)*|[^\s]")
# A plain chunk's tokens take at most this from the lead of "outside" of a token near them.
NUDGE = 0.25
# Longer tokens are known by their shape only.
LONGEST_WORD = 12
OFFSETS = 5  # a token itself, three before it, one behind it


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), in order."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _KEYWORDS):
        found += [
            (m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), *m.span()) for m in _TOKEN.finditer(text)]


def shape(token: str) -> str:
    """Runs of upper case, lower case, digits and others as one sign each, at most six."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token]
    return "".join(c for i, c in enumerate(kinds) if not i or c != kinds[i - 1])[:6]


def own_features(token: str) -> list[str]:
    n = len(token)
    out = ["bias", f"shape={shape(token)}", f"length={min(n.bit_length(), 7)}"]
    digits = sum(c.isdigit() for c in token)
    if digits:
        turns = sum(token[i].isdigit() != token[i - 1].isdigit() for i in range(1, n))
        entropy = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
        out += [f"digits={4 * digits // n}", f"turns={min(turns, 6)}", f"entropy={int(2 * entropy)},{n >= 16}"]
    if n >= 8 and digits:
        out.append("long with digits")
        if re.fullmatch(r"[0-9a-f]+", token):
            out.append("hexadecimal")
        if re.fullmatch(r"[A-Z0-9]+", token):
            out.append("capitals and digits")
    if n <= LONGEST_WORD and not digits:
        out.append(f"word={token.lower()}")
    return out


def near_feature(token: str) -> str:
    return token.lower() if len(token) <= LONGEST_WORD and not any(c.isdigit() for c in token) else f"shape={shape(token)}"


def features(token: str) -> list[list[str]]:
    """For each offset the features that a token adds to the token at that offset from it."""
    near = near_feature(token)
    return [own_features(token), *([f"{offset}:{near}"] for offset in range(1, OFFSETS))]


FILE_FEATURES = ("file length=", "file digits=", "file lines=")


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    digits = sum(map(text.count, "0123456789"))
    values = (n.bit_length(), min(100 * digits // n, 10), text.count("\n").bit_length())
    return [f"{name}{value}" for name, value in zip(FILE_FEATURES, values, strict=True)]


def _training_windows(text: str | None, ordinary: bool) -> dict:
    """Windows of tokens with tags: around base spans, and around an arbitrary token of some other documents."""
    text = text or ""
    spans = base_spans(text)
    windows: list[dict] = []
    if spans or ordinary:
        tokens = tokens_of(text)
        tags = [OUTSIDE] * len(tokens)
        centres = []
        for _, _, end, start in spans:
            own = [i for i, (_, a, b) in enumerate(tokens) if a < end and b > start]
            for k, i in enumerate(own):
                if tags[i] == OUTSIDE:
                    tags[i] = INSIDE if k else BEGIN
            centres += own[:1]
        if not spans and tokens:
            centres = [hash_of(text) % len(tokens)]
        for centre in centres[:WINDOWS]:
            cut = slice(max(0, centre - AROUND), centre + AROUND + 1)
            windows.append({"tokens": [t for t, _, _ in tokens[cut]], "tags": tags[cut], "file": file_features(text)})
    return {"windows": windows}


def hash_of(text: str) -> int:
    """The same on every worker, unlike Python's own."""
    return len(text) * 7919 + sum(map(ord, text[:64]))


class Field:
    """Weights by feature and tag, and by pairs of neighbouring tags."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        # What a tag other than outside may win back by its two transitions.
        self.gain = np.array(
            [(moves[:, y] - moves[:, OUTSIDE]).max() + (moves[y] - moves[OUTSIDE]).max() for y in (BEGIN, INSIDE)]
        )
        self.worst_file = self._worst_file()
        # Features that name a word end with it.
        self.words = {re.split("[=:]", name, maxsplit=1)[-1] for name in index}
        self._fresh()

    def __getstate__(self) -> tuple:
        return self.index, self.weights, self.moves

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _worst_file(self) -> np.ndarray:
        """The least that a file can add to the lead of outside over begin and inside."""
        total = np.zeros(2)
        for prefix in FILE_FEATURES:
            leads = [self.lead(self.weights[at]) for name, at in self.index.items() if name.startswith(prefix)]
            total += np.min([np.zeros(2), *leads], axis=0)
        return total

    @staticmethod
    def lead(scores: np.ndarray) -> np.ndarray:
        return scores[..., OUTSIDE, None] - scores[..., :OUTSIDE]

    def _fresh(self) -> None:
        self.plain: set[str] = set()
        self.rows: dict[object, int] = {}
        self.matrix = np.zeros((4096, OFFSETS, 3))
        self.quiet: list[bool] = []

    def _sum(self, names: list[str]) -> np.ndarray:
        known = [self.index[name] for name in names if name in self.index]
        return self.weights[known].sum(axis=0)

    def _row(self, token: str) -> int:
        key: object = token
        if token.isalpha() and token.lower() not in self.words:
            # Words without a weight of their own differ in shape and length only.
            n = len(token)
            case = 1 if token.islower() else 2 if token.isupper() else shape(token)
            key = (case, n.bit_length(), n <= LONGEST_WORD)
        if key not in self.rows:
            at = self.rows[key] = len(self.rows)
            if at >= len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[at] = [self._sum(names) for names in features(token)]
            own, near = self.lead(self.matrix[at, 0]), self.lead(self.matrix[at, 1:])
            safe = own + self.worst_file - (OFFSETS - 1) * NUDGE > self.gain
            self.quiet.append(bool(safe.all() and (near > -NUDGE).all()))
        return self.rows[key]

    def _is_plain(self, chunk: str) -> bool:
        """Whether a chunk's tokens are outside among other plain chunks."""
        stem = chunk.rstrip(".,")
        tokens = [stem, *set(chunk[len(stem) :])] if stem.isalpha() else _TOKEN.findall(chunk)
        plain = all([self.quiet[self._row(token)] for token in tokens])
        if plain:
            self.plain.add(chunk)
        return plain

    def scores(self, chunks: list[str], file: np.ndarray) -> np.ndarray:
        """Of each token of neighbouring chunks, by tag. Tokens never hold white space."""
        own = self.matrix[[self._row(token) for chunk in chunks for token in _TOKEN.findall(chunk)]]
        total = own[:, 0] + file
        for back in (1, 2, 3):
            total[back:] += own[:-back, back]
        total[:-1] += own[1:, OFFSETS - 1]
        return total

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Places of the secrets on the best path."""
        if not self.index:
            return []
        if len(self.plain) + len(self.rows) > REMEMBERED:
            self._fresh()
        chunks = text.split()
        if not (odd := {chunk for chunk in set(chunks) - self.plain if not self._is_plain(chunk)}):
            return []
        # Tokens next to an odd chunk are scored with as many chunks around them as features reach.
        reach = 2 * (OFFSETS - 1)
        near = np.flatnonzero([chunk in odd for chunk in chunks])
        file, places, out = self._sum(file_features(text)), None, []
        for run in np.split(near, np.flatnonzero(np.diff(near) > 2 * reach) + 1):
            first, end = max(0, int(run[0]) - reach), int(run[-1]) + reach + 1
            scores = self.scores(chunks[first:end], file)
            loose = ~(self.lead(scores) > self.gain).all(axis=1)
            # Tokens at the ends of the stretch lack some that are around them; they are plain.
            loose[: OFFSETS - 1] &= first == 0
            loose[len(loose) - OFFSETS + 1 :] &= end >= len(chunks)
            tags = self._tags(scores, np.flatnonzero(loose))
            if any(tag != OUTSIDE for tag in tags.values()):
                places = places or [match.span() for match in re.finditer(r"\S+", text)]
                start = places[first][0]
                tokens = tokens_of(text[start : places[min(end, len(chunks)) - 1][1]])
                out += [(start + a, start + b) for a, b in self._joined(tags, tokens)]
        return out

    def _tags(self, scores: np.ndarray, loose: np.ndarray) -> dict[int, int]:
        tags: dict[int, int] = {}
        for run in np.split(loose, np.flatnonzero(np.diff(loose) > 1) + 1) if len(loose) else []:
            first, end = int(run[0]), int(run[-1]) + 1
            tags |= zip(range(first, end), self.decoded(scores[first:end], first > 0, end < len(scores)), strict=True)
        return tags

    @staticmethod
    def _joined(tags: dict[int, int], tokens: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for i in sorted(tags):
            if tags[i] == OUTSIDE:
                continue
            _, start, end = tokens[i]
            if tags[i] == INSIDE and out and tags.get(i - 1, OUTSIDE) != OUTSIDE:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
        return out

    def decoded(self, scores: np.ndarray, after_outside: bool, before_outside: bool) -> list[int]:
        """Viterbi over a stretch, next to tokens outside or to an end of the text."""
        moves = self.moves.tolist()
        rows = scores.tolist()
        best = [rows[0][y] + (moves[OUTSIDE][y] if after_outside else 0) for y in range(3)]
        back = []
        for row in rows[1:]:
            came = [max(range(3), key=lambda x, y=y: best[x] + moves[x][y]) for y in range(3)]
            best = [best[came[y]] + moves[came[y]][y] + row[y] for y in range(3)]
            back.append(came)
        if before_outside:
            best = [best[y] + moves[y][OUTSIDE] for y in range(3)]
        path = [max(range(3), key=best.__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


def train(windows: list[dict]) -> Field:
    """Maximum likelihood with forward and backward sums over all windows side by side."""
    if not any(tag != OUTSIDE for window in windows for tag in window["tags"]):
        return Field({}, np.zeros((0, 3)), np.zeros((3, 3)))
    names = []
    for window in windows:
        own = [features(token) for token in window["tokens"]]
        for i in range(len(own)):
            of = own[i][0] + window["file"]
            for offset, j in ((1, i - 1), (2, i - 2), (3, i - 3), (4, i + 1)):
                if 0 <= j < len(own):
                    of = of + own[j][offset]
            names.append(of)
    counts = Counter(name for of in names for name in of)
    # A feature seen a few times only says what it was seen with.
    index = {name: i for i, name in enumerate(sorted(name for name, k in counts.items() if k > 3))}
    row = np.array([i for i, of in enumerate(names) for name in of if name in index])
    column = np.array([index[name] for of in names for name in of if name in index])
    lengths = np.array([len(window["tokens"]) for window in windows])
    n, longest = len(windows), int(lengths.max())
    there = np.arange(longest) < lengths[:, None]
    tags = np.zeros((n, longest), np.int64)
    tags[there] = [tag for window in windows for tag in window["tags"]]
    truth = np.eye(3)[tags] * there[..., None]
    both = there[:, 1:] & there[:, :-1]
    true_moves = np.einsum("ntx,nty->xy", truth[:, :-1] * both[..., None], truth[:, 1:])

    weights, moves = np.zeros((len(index), 3)), np.zeros((3, 3))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, moves)]
    for step in range(1, STEPS + 1):
        flat = np.stack([np.bincount(row, weights[column, y], minlength=len(names)) for y in range(3)], axis=1)
        scores = np.zeros((n, longest, 3))
        scores[there] = flat
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(there[:, t, None], np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + scores[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            onward = np.logaddexp.reduce(moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(there[:, t + 1, None], onward, 0.0)
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)[:, None]
        chance = np.exp(ahead + behind - whole[..., None]) * there[..., None]
        pair = ahead[:, :-1, :, None] + moves + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[..., None, None]
        expected = (np.exp(pair) * both[..., None, None]).sum(axis=(0, 1))
        error = (chance - truth)[there]
        slopes = np.stack([np.bincount(column, error[row, y], minlength=len(index)) for y in range(3)], axis=1)
        for param, (first, second), slope in (
            (weights, state[0], slopes / n + PENALTY * weights),
            (moves, state[1], (expected - true_moves) / n + PENALTY * moves),
        ):
            first *= 0.9
            first += 0.1 * slope
            second *= 0.99
            second += 0.01 * slope**2
            param -= LEARNING_RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(index, weights, moves)


_WINDOWS = "windows: array<struct<tokens: array<string>, tags: array<int>, file: array<string>>>"


def fitted(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    texts = docs.select("text").filter(F.col("text").isNotNull())
    share = int(min(1.0, rows / max(1, docs.count())) * (1 << 20))
    chosen = texts.filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20)) < share)
    ordinary = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(ORDINARY)) == 0
    made = chosen.select(computed(_training_windows, _WINDOWS, F.col("text"), ordinary).alias("w"))
    # Copies of a text teach nothing new, and an order makes sums repeat to the last digit.
    windows = made.select(F.explode("w.windows").alias("w")).distinct().orderBy("w")
    return train([r["w"].asDict() for r in windows.collect()])


_SPANS = "spans: array<struct<start: int, kind: int, end: int>>"


def spans_in(text: Column, field: Field, docs: DataFrame) -> Column:
    """Per row all spans, base ones and those of the field, in order of start and kind."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def over(text: str | None) -> dict:
        text = text or ""
        base = base_spans(text)
        more = [
            (start, KINDS.index("crf"), end, start)
            for start, end in sent.value.spans(text)
            if not any(start < b and end > a for a, _, b, _ in base)
        ]
        return {"spans": [{"start": a, "kind": kind, "end": b} for a, kind, b, _ in sorted(base + more)]}

    return computed(over, _SPANS, text)["spans"]


def scanned(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and its spans (start, kind, end)."""
    return docs.select("doc_id", spans_in(F.col("text"), field, docs).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, and spans as text and digest."""
    kinds = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
        )

    def number_of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [number_of(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask(text: str | None, spans: list[dict]) -> str | None:
    """The text with each run of overlapping spans replaced by MASK."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], MASK]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with secrets masked in the text, and n_chars, where there is such a column, counted again."""
    def over(text: str | None, spans: list[dict]) -> dict:
        return {"text": mask(text, spans)}

    masked = computed(over, "text: string", F.col("text"), spans_in(F.col("text"), field, docs))["text"]
    out = docs.withColumn("text", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
