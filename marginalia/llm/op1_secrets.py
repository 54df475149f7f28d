"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags every token as outside, begin or inside of a secret from its shape, its neighbouring words and features of
the whole text; Viterbi decoding gives the best tag sequence. It learns from the patterns' finds in a bounded sample, and
adds spans where a secret's surroundings and shape tell it although no pattern matches.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .shared import Shipped, append, give_back, named, one_text_each, run_hashes, slices, tidy

# --- fixed values: the base patterns --------------------------------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "auth", "credential", "bearer", "private", "access", "pwd")
# --- end of fixed values --------------------------------------------------------------------------------------------

SAMPLE_TEXTS = 1_500
SAMPLE_WINDOWS = 3_000
TEXT_WINDOWS = 20
WINDOW = 48
STEPS = 60
TOGETHER = 250
OUTSIDE, BEGIN, INSIDE = range(3)
BUCKETS = 512
MASK = "[secret]"


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the secret itself)`` of the pattern finds, by start, then kind.

    ``hexes`` is false if it is known already that there is no run of 24 hexadecimal digits.
    """
    found, low = [], text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    if hexes:
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a line feed after each, and where each starts (one more entry: the end)."""
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), starts


def character_kinds() -> np.ndarray:
    """0 white space, 1 word character, 2 a token of its own (code points below 128; all others are word characters)."""
    kinds = np.full(129, 2, np.uint8)
    kinds[:33], kinds[128] = 0, 1
    for c in (*range(48, 58), *range(65, 91), *range(97, 123), *b"_+/-"):
        kinds[c] = 1
    return kinds


class Tokens:
    """Tokens of a few texts as arrays: bounds, text number, and one feature number per feature group.

    Groups: shape (make-up and length of the token), digits (their share and the changes between letters and digits),
    make-up and length each alone, the four tokens before (keywords, assignment signs, quotes, others by hash), the two after, and the text (keywords in
    it, share of digits, size).
    """

    GROUPS = 11

    def __init__(self, texts: list[str]):
        codes, self.at = code_points(texts)
        small = np.minimum(codes, 128).astype(np.uint8)
        kind = character_kinds()[small]
        change = np.ones(len(kind) + 1, bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edges = np.flatnonzero(change)
        used = kind[edges[:-1]] > 0
        self.starts, self.ends = edges[:-1][used], edges[1:][used]
        self.text = np.searchsorted(self.at, self.starts, "right") - 1
        n = len(self.starts)
        self.features = np.zeros((n, self.GROUPS), np.int64, order="F")  # one group after the other
        self.with_hex: set[int] = set()
        if not n:
            return

        def count(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
            return total[self.ends] - total[self.starts]

        size = self.ends - self.starts
        is_digit = (small >= 48) & (small <= 57)
        is_low, is_up = (small >= 97) & (small <= 122), (small >= 65) & (small <= 90)
        digit, low, up = count(is_digit), count(is_low), count(is_up)
        is_hex = is_digit | ((small >= 97) & (small <= 102))
        hexes = count(is_hex)
        self.with_hex = set(self.text[np.flatnonzero(longest_runs(is_hex, self.starts, self.ends) >= 24)].tolist())
        turns = count(np.concatenate([[False], is_digit[1:] != is_digit[:-1]]))
        mark = kind[self.starts] == 2
        letters = low + up
        make = np.select(
            [mark, low == size, up == size, digit == size, (up == 1) & (low == size - 1), (hexes == size) & (digit > 0), (digit > 0) & (up + digit == size), (digit > 0) & (letters + digit == size), digit > 0, letters == size],
            np.arange(10),
            10,
        )
        first = small[self.starts]
        long_ = np.searchsorted([2, 3, 5, 8, 12, 16, 20, 24, 32, 40], size, "right")
        self.features[:, 0] = np.where(mark, 121 + np.minimum(first, 127), make * 11 + long_)
        self.features[:, 9] = np.where(mark, 11, make)
        self.features[:, 10] = np.where(mark, 11, long_)
        share = np.ceil(4 * digit / size).astype(np.int64)
        self.features[:, 1] = share * 8 + np.minimum(turns, 7)
        fold = np.arange(129, dtype=np.uint8)
        fold[65:91] += 32
        word = run_hashes(fold[small], self.starts, self.ends, 21)
        listed = keyword_hashes()
        hit = np.searchsorted(listed, word) % len(listed)
        keyword = listed[hit] == word
        name = np.where(mark, 1 + np.minimum(first, 127), np.where(keyword, 130 + hit, 160 + (word % np.uint64(BUCKETS - 161)).astype(np.int64)))
        for g, by in enumerate((1, 2, 3, 4, -1, -2)):
            near = np.zeros(n, np.int64)
            a, b = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
            near[a] = np.where(self.text[a] == self.text[b], name[b], 0)
            self.features[:, 2 + g] = near
        sizes, many = np.diff(self.at) - 1, len(texts)
        digits = np.bincount(self.text, digit, many) / np.maximum(sizes, 1)
        some = np.bincount(self.text, keyword, many) > 0
        whole = some * 16 + np.minimum(digits * 40, 3).astype(np.int64) * 4 + np.searchsorted([500, 3000, 20000], sizes)
        self.features[:, 8] = whole[self.text]

    def tags(self, spans: list[list[tuple[int, int]]]) -> np.ndarray:
        """Tags from the (start, end) spans of each text."""
        out = np.zeros(len(self.starts), np.int64)
        for i, some in enumerate(spans):
            for a, b in sorted(some):
                one, two = np.searchsorted(self.ends, self.at[i] + a, "right"), np.searchsorted(self.starts, self.at[i] + b)
                if two > one:
                    out[one:two] = INSIDE
                    out[one] = BEGIN
        return out


def longest_runs(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length of the longest run of set flags within each token; tokens of fewer places than 24 count as 0."""
    out = np.zeros(len(starts), np.int64)
    for i in np.flatnonzero(ends - starts >= 24).tolist():
        off = np.flatnonzero(np.concatenate([[True], ~flags[starts[i] : ends[i]], [True]]))
        out[i] = np.diff(off).max() - 1
    return out


def keyword_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(KEYWORDS).encode(), np.uint8)
    ends = np.cumsum([len(k) + 1 for k in KEYWORDS]) - 1
    return np.sort(run_hashes(data, ends - [len(k) for k in KEYWORDS], ends, 21))


class Field:
    """A linear-chain conditional random field with tags outside, begin, inside; weights by maximum likelihood."""

    def __init__(self):
        self.weights = np.zeros((Tokens.GROUPS, BUCKETS, 3))
        self.moves = np.zeros((3, 3))
        self.ends = np.zeros((2, 3))  # of the first and the last tag
        self.weights[8, :, OUTSIDE] = 0.5

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for g in range(Tokens.GROUPS):
            out += np.take(self.weights[g], features[:, g], 0)
        return out

    def fit(self, features: np.ndarray, tags: np.ndarray, decay: float = 2e-4) -> None:
        """``features`` (windows x places x groups) and ``tags`` (windows x places, -1 beyond the end).

        A step takes ``TOGETHER`` windows at a time; beside the features, only three numbers of each place are held for all windows. The sums
        run over the places in their order, so they do not depend on ``TOGETHER``.
        """
        n = len(tags)
        there = tags >= 0
        last = there.sum(1) - 1
        flat = features[there]
        at = np.concatenate([[0], np.cumsum(last + 1)])
        parts = [slice(a, min(n, a + TOGETHER)) for a in range(0, n, TOGETHER)]

        def gold_of(part: slice) -> np.ndarray:
            return np.eye(3)[np.maximum(tags[part], 0)] * there[part, :, None]

        pairs, begins, ends = np.zeros((3, 3)), np.zeros(3), np.zeros(3)
        for part in parts:
            gold = gold_of(part)
            pairs += np.einsum("nia,nib->ab", gold[:, :-1] * there[part, 1:, None], gold[:, 1:])
            begins += gold[:, 0].sum(0)
            ends += gold[np.arange(len(gold)), last[part]].sum(0)
        state = [self.weights, self.moves, self.ends]
        m, v = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
        off, heads, tails = np.empty((len(flat), 3)), np.empty((n, 3)), np.empty((n, 3))
        for step in range(1, STEPS + 1):
            moved = np.zeros((1, 3, 3))
            for part in parts:
                places = slice(at[part.start], at[part.stop])
                chance, both = self.chances(flat[places], there[part], last[part])
                off[places] = (chance - gold_of(part))[there[part]]
                heads[part], tails[part] = chance[:, 0], chance[np.arange(len(chance)), last[part]]
                moved = np.concatenate([moved, both.reshape(-1, 3, 3)]).sum(0, keepdims=True)
            grads = [np.zeros_like(self.weights), moved[0] - pairs, np.stack([heads.sum(0) - begins, tails.sum(0) - ends])]
            for g in range(Tokens.GROUPS):
                for t in range(3):
                    grads[0][g, :, t] = np.bincount(flat[:, g], off[:, t], BUCKETS)
            for i, (g, x) in enumerate(zip(grads, state)):
                g = g / n + decay * x
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g**2
                x -= 0.15 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)

    def chances(self, flat: np.ndarray, there: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each tag at each place of the windows, and of each two tags in a row."""
        n, size = there.shape
        e = np.zeros((n, size, 3))
        e[there] = self.emissions(flat)
        forward, back = np.empty_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + self.ends[0]
        for i in range(1, size):
            forward[:, i] = log_sum(forward[:, i - 1][:, :, None] + self.moves, 1) + e[:, i]
        for i in range(size - 1, -1, -1):
            on = log_sum(self.moves + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2) if i + 1 < size else 0
            back[:, i] = np.where((last == i)[:, None], self.ends[1], np.where((last > i)[:, None], on, 0))
        total = log_sum(forward[:, 0] + back[:, 0], 1)
        chance = np.exp(forward + back - total[:, None, None]) * there[:, :, None]
        both = np.exp(forward[:, :-1, :, None] + self.moves + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        return chance, both

    def decode(self, emissions: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Best tag sequence of each text (Viterbi; ties: the lower tag).

        A token whose lead for ``outside`` exceeds all that transitions could ever give back is outside in every best
        sequence, so the recursion only has to run over the stretches between such tokens, all of a length at once.
        """
        n, out = len(emissions), np.zeros(len(emissions), np.int64)
        if not n:
            return out
        first = np.ones(n, bool)
        first[1:] = texts[1:] != texts[:-1]
        final = np.append(first[1:], True)
        e = emissions + first[:, None] * self.ends[0] + final[:, None] * self.ends[1]
        lead = e[:, OUTSIDE] - e[:, 1:].max(1)
        most = 2 * (self.moves.max() - self.moves.min())
        open_ = ~(lead > most)
        starts = np.flatnonzero(open_ & (first | ~np.append(False, open_[:-1])))
        ends = np.flatnonzero(open_ & (final | ~np.append(open_[1:], False))) + 1
        for size in np.unique(ends - starts).tolist():
            at = starts[ends - starts == size]
            score = e[at] + np.where(first[at], 0, 1)[:, None] * self.moves[OUTSIDE]
            came = np.empty((size, len(at), 3), np.int8)
            for i in range(1, size):
                ways = score[:, :, None] + self.moves
                came[i] = ways.argmax(1)
                score = ways.max(1) + e[at + i]
            tag = (score + np.where(final[at + size - 1], 0, 1)[:, None] * self.moves[:, OUTSIDE]).argmax(1)
            for i in range(size - 1, -1, -1):
                out[at + i] = tag
                if i:
                    tag = came[i, np.arange(len(at)), tag]
        return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def evenly(places: list[int], n: int) -> list[int]:
    return places if len(places) <= n else [places[i * len(places) // n] for i in range(n)]


def training_windows(batches):
    """``f, t``: features and tags of windows of tokens: of each text at most ``TEXT_WINDOWS`` with a secret and as many without.

    Windows without a secret are thinned by position; of too many, those spread evenly over the text are taken.
    """
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            texts = [t or "" for t in part.column(0).to_pylist()]
            tokens = Tokens(texts)
            tags = tokens.tags([[(s, b) for _, _, b, s in base_spans(t)] for t in texts])
            f, t = [], []
            begins = np.searchsorted(tokens.text, np.arange(len(texts) + 1))
            for a, b in zip(begins.tolist(), begins[1:].tolist()):
                secret = [at for at in range(a, b, WINDOW) if tags[at : min(b, at + WINDOW)].any()]
                plain = sorted(set(range(a, b, 16 * WINDOW)) - set(secret))
                for at in sorted(evenly(secret, TEXT_WINDOWS) + evenly(plain, TEXT_WINDOWS)):
                    upto = min(b, at + WINDOW)
                    f.append(tokens.features[at:upto].astype(np.int32).reshape(-1))
                    t.append(tags[at:upto].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), pa.array(t, pa.list_(pa.int32()))], ["f", "t"])


def ranked_windows(batches):
    """``plain, lot, f, t``: the training windows as bytes, two a feature number and one a tag, with what they are chosen by."""
    for batch in training_windows(batches):
        plain, lot, f, t = [], [], [], []
        for x, y in zip(batch.column(0), batch.column(1)):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            plain.append(not y.any())
            lot.append(int(np.dot(x % 1009, np.arange(len(x)) % 997) % 10007))
            f.append(x.astype("<i2").tobytes())
            t.append(y.astype("<i1").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(plain, pa.bool_()), pa.array(lot, pa.int64()), pa.array(f, pa.binary()), pa.array(t, pa.binary())], ["plain", "lot", "f", "t"])


def varied(f: np.ndarray, t: np.ndarray, seed: int) -> np.ndarray:
    """A copy of a window's features in which its secrets have another make-up and length and its keywords other names.

    The patterns know few keywords and shapes; the copies keep the field from learning those by heart.
    """
    rng, f = np.random.default_rng(seed), f.copy()
    for at in np.flatnonzero(t):
        make, length = int(rng.integers(5, 9)), int(rng.integers(4, 11))
        if f[at, 9] < 11:  # not a mark inside of the secret
            f[at, 0], f[at, 9], f[at, 10] = make * 11 + length, make, length
            f[at, 1] = int(rng.integers(1, 4)) * 8 + int(rng.integers(3, 8))
    names = f[:, 2:8]
    named_ = (names >= 130) & (names < 130 + len(KEYWORDS))
    names[named_] = 130 + (names[named_] - 130 + int(rng.integers(1, len(KEYWORDS)))) % len(KEYWORDS)
    return f


def fit(docs: DataFrame, sample: int = SAMPLE_TEXTS, doc_id: str = "doc_id", text: str = "text") -> Field:
    """Learn from at most ``sample`` texts that may hold a secret and as many others (lowest id hash first).

    The patterns' finds are the tags. An id that repeats teaches one of its texts, and a text at most 20 windows with a secret and
    20 without. Of all those, Spark takes 3,000, those with a secret first, and no others reach the driver, which trains on them and on
    varied copies of those with a secret. Without any text nothing is learned and nothing is ever tagged.
    """
    rows = named(docs, doc_id=doc_id, text=text).where("doc_id is not null and text is not null")
    hint = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    lot = (F.xxhash64("doc_id"), "doc_id")
    keys = rows.where(hint).select("doc_id").distinct().orderBy(*lot).limit(sample).union(rows.select("doc_id").distinct().orderBy(*lot).limit(sample)).distinct()
    windows = one_text_each(rows, keys, "doc_id").select("text").mapInArrow(tidy(ranked_windows), "plain boolean, lot bigint, f binary, t binary")
    found = windows.orderBy("plain", "lot", "f", "t").limit(SAMPLE_WINDOWS).select("f", "t").toArrow()
    field = Field()
    if len(found):
        field.fit(*training_set(found))
    del found
    give_back()
    return field


def training_set(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of the windows ``f, t``, and of a varied copy of each that has a secret."""
    f = [np.frombuffer(x.as_buffer(), "<i2").reshape(-1, Tokens.GROUPS) for x in found["f"]]
    t = [np.frombuffer(x.as_buffer(), "<i1") for x in found["t"]]
    copied = [i for i, x in enumerate(t) if x.any()]
    tags = np.full((len(t) + len(copied), WINDOW), -1, np.int8)
    features = np.zeros((*tags.shape, Tokens.GROUPS), np.int16)
    for at, i in enumerate([*range(len(t)), *copied]):
        tags[at, : len(t[i])] = t[i]
        features[at, : len(t[i])] = f[i] if at < len(t) else varied(f[i], t[i], i)
    return features, tags


def find_secrets(texts: list[str], field: Field) -> list[list[tuple[int, int, int, int]]]:
    """``(start, kind, end, start of the secret itself)`` of each text: the patterns' finds and the field's others.

    A span of the field that touches a pattern's find is left out: the pattern's stays.
    """
    tokens = Tokens(texts)
    found = [base_spans(t, i in tokens.with_hex) for i, t in enumerate(texts)]
    tags = field.decode(field.emissions(tokens.features), tokens.text)
    tagged = np.flatnonzero(tags)
    if not len(tagged):
        return found
    heads = np.ones(len(tagged), bool)
    heads[1:] = (tags[tagged[1:]] == BEGIN) | (np.diff(tagged) > 1) | (tokens.text[tagged[1:]] != tokens.text[tagged[:-1]])
    first = np.flatnonzero(heads)
    last = np.append(first[1:], len(tagged)) - 1
    for a, b in zip(tagged[first].tolist(), tagged[last].tolist()):
        i = int(tokens.text[a])
        start, end = int(tokens.starts[a] - tokens.at[i]), int(tokens.ends[b] - tokens.at[i])
        if all(end <= s or start >= e for s, _, e, _ in found[i]):
            found[i].append((start, 3, end, start))
    return [sorted(x) for x in found]


FIELDS = [StructField(n, LongType()) for n in ("n_assign", "n_access", "n_hex")] + [StructField("base_sha256", StringType()), StructField("spans", StringType())]


def with_secrets(docs: DataFrame, field: Field, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the number of finds of each pattern, a digest of those and all spans.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by start, then kind, of the patterns' whole matches and of
    the field's spans (kind ``crf``); ``base_sha256`` is the digest of the same list of the patterns alone. A null text is
    empty and has no span.
    """
    shipped = Shipped(docs.sparkSession, field)

    def make():
        def work(column: pa.Array):
            spans = find_secrets([t or "" for t in column.to_pylist()], shipped.value)
            listed = [[f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in x] for x in spans]
            base = [",".join(s for s in x if not s.startswith("crf:")) for x in listed]
            counts = [np.array([sum(k == kind for _, k, _, _ in x) for x in spans], np.int64) for kind in range(3)]
            return [*counts, [hashlib.sha256(x.encode()).hexdigest() for x in base], [",".join(x) for x in listed]]

        return work

    return append(docs, text, [StructField(prefix + f.name, f.dataType) for f in FIELDS], make, 1 << 19)


def masked(docs: DataFrame, field: Field, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[secret]`` (of an assignment, its value alone).

    Texts without a find are as they were, null ones too. ``length``, if there, becomes the length of the new text.
    """
    shipped, name = Shipped(docs.sparkSession, field), "_masked"
    while name in {c.lower() for c in docs.columns}:
        name += "_"

    def make():
        def work(column: pa.Array):
            texts = column.to_pylist()
            return [[t if t is None or not x else cover(t, x) for t, x in zip(texts, find_secrets([t or "" for t in texts], shipped.value))]]

        return work

    out = append(docs, text, [StructField(name, StringType())], make, 1 << 19)
    changed = {text: F.col(name)}
    if length in docs.columns and length != text:
        changed[length] = F.when(F.col(name).eqNullSafe(F.col(f"`{text}`")), F.col(f"`{length}`")).otherwise(F.char_length(name).cast(docs.schema[length].dataType))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def cover(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    out, at = [], 0
    for begin, end in sorted((s, b) for _, _, b, s in spans):
        if begin >= at:
            out += [text[at:begin], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])
