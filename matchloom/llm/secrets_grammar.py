"""Secret scans: patterns, and automata inferred from labelled credentials for the formats patterns don't name."""

from __future__ import annotations

import math
import random
import re
import string
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_limits, table

KINDS = ("assign", "access", "hex", "grammar")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are matched whole, so these are the runs of 24 and more
#: Candidates are runs of these characters, and their parts between those of SPLITS.
MARKS, SPLITS = "+/_.=-", "/.="

#: Evidence for a merge: the confidence of the Hoeffding bound.
ALPHA = 0.05
#: A candidate is a secret from so many nats by which the credentials' automaton beats the ordinary one's: ordinary
#: strings are taken to be 100,000 times as common.
EVIDENCE = math.log(100_000)
#: Added to every count when probabilities are taken, the end of a string's too.
SMOOTH = 0.05


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


#: Classes of characters: hex letters, other small letters, capitals, digits; marks stand for themselves.
ALPHABET = "hlud" + MARKS
_CLASS = {c: "h" for c in "abcdef"} | {c: "l" for c in string.ascii_lowercase[6:]} | {c: "u" for c in string.ascii_uppercase} | {c: "d" for c in string.digits}


def symbols(token: str) -> str:
    """Classes of the characters of a string over letters, digits and MARKS."""
    return "".join(_CLASS.get(c, c) for c in token)


class Automaton:
    """Deterministic probabilistic automaton: next state and count by state and symbol, count of ends by state."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end = [0]
        for word in words:  # the prefix tree
            s = 0
            for c in word:
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.end.append(0)
                self.count[s][c] = self.count[s].get(c, 0) + 1
                s = self.next[s][c]
            self.end[s] += 1
        self._merge(alpha)
        self.total = [sum(self.count[s].values()) + self.end[s] for s in range(len(self.next))]

    def _visits(self, s: int) -> int:
        return sum(self.count[s].values()) + self.end[s]

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        """Are the futures of two states compatible? b is the root of a tree, so this ends."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._visits(a), self._visits(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[a] / n - self.end[b] / m) > bound:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds tree b into state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self, alpha: float) -> None:
        """Red states stay; each blue one, a successor of a red, is merged into the first red it is compatible with, or turns red."""
        red = [0]
        while True:
            blue = min(((t, s, c) for s in red for c, t in self.next[s].items() if t not in red), default=None)
            if blue is None:
                break
            t, s, c = blue
            for r in red:
                if self._alike(r, t, alpha):
                    self.next[s][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
        place = {s: k for k, s in enumerate(red)}
        self.count, self.end = [self.count[s] for s in red], [self.end[s] for s in red]
        self.next = [{c: place[t] for c, t in self.next[s].items()} for s in red]

    def log_likelihood(self, word: str) -> float:
        """Natural logarithm of the probability of a string of classes, its end included; what was never seen has a small share everywhere."""
        s, out = 0, 0.0
        all_ = SMOOTH * (len(ALPHABET) + 1)
        for c in word:
            out += math.log((self.count[s].get(c, 0) + SMOOTH) / (self.total[s] + all_))
            s = self.next[s].get(c, s)
        return out + math.log((self.end[s] + SMOOTH) / (self.total[s] + all_))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By state and class the next state and the logarithm of the probability, and that of the end by state."""
        states, all_ = len(self.next), SMOOTH * (len(ALPHABET) + 1)
        follow = np.array([[self.next[s].get(c, s) for c in ALPHABET] for s in range(states)], np.int32)
        count = np.array([[self.count[s].get(c, 0) for c in ALPHABET] for s in range(states)], float)
        total = np.array(self.total, float)
        return follow, np.log((count + SMOOTH) / (total + all_)[:, None]), np.log((np.array(self.end) + SMOOTH) / (total + all_))


def labelled_credentials(each: int = 120, seed: int = 5) -> tuple[list[str], list[str]]:
    """(credentials, ordinary strings), made by rule in publicly documented formats: the default training set."""
    r = random.Random(seed)
    low, up, dig, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    good, plain = [], []
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "sch", "ung", "que", "ment", "cion"]
    word = lambda n: "".join(r.choice(syllables) for _ in range(n))
    for _ in range(each):
        good += [
            "ghp_" + of(low + up + dig, 36),
            "sk_live_" + of(low + up + dig, 24),
            "xoxb-" + of(dig, 12) + "-" + of(dig, 12) + "-" + of(low + up + dig, 24),
            "AIza" + of(low + up + dig + "_-", 35),
            "eyJ" + of(low + up + dig, 33) + "." + of(low + up + dig + "_-", 60) + "." + of(low + up + dig + "_-", 43),
            "glpat-" + of(low + up + dig + "_-", 20),
            of(low + up + dig + "+/", 40),
            of(low + up + dig, r.randint(20, 64)),
            of(hexa, 8) + "-" + of(hexa, 4) + "-" + of(hexa, 4) + "-" + of(hexa, 4) + "-" + of(hexa, 12),
        ]
        plain += [
            word(r.randint(6, 12)),
            word(r.randint(6, 12)).capitalize(),
            word(r.randint(6, 12)).upper(),
            word(3) + "_" + word(3) + "_" + word(2) + str(r.randint(0, 99)),
            word(2) + "-" + word(3) + "-" + word(2),
            "www." + word(3) + "." + r.choice(["com", "org", "example.com", "net"]),
            "//" + word(3) + ".com/" + word(2) + "/" + word(3) + "/" + of(dig, r.randint(1, 4)),
            word(3) + "." + of(dig, 2) + "-" + word(2) + str(r.randint(1, 99)) + ".example.com",
            word(2).capitalize() + word(2).capitalize() + word(2).capitalize(),
            of(dig, 4) + "-" + of(dig, 2) + "-" + of(dig, 2) + "-" + of(dig, 6),
            of(dig, r.randint(16, 20)),
            r.choice("-=_.") * r.randint(16, 60),
            ".".join(of(dig, r.randint(1, 3)) for _ in range(r.randint(5, 8))),
            # short ones: words, abbreviations with endings, numbers with units, codes, names and values
            word(r.randint(1, 5)),
            word(r.randint(1, 5)).capitalize(),
            of(up, r.randint(2, 4)) + word(r.randint(1, 3)),
            word(r.randint(1, 2)) + of(up, r.randint(1, 3)) + word(r.randint(0, 2)),
            of(dig, r.randint(1, 7)),
            of(dig, r.randint(1, 4)) + r.choice([".", "-", "/"]) + of(dig, r.randint(1, 4)),
            of(dig, r.randint(1, 4)) + word(1)[: r.randint(1, 3)],
            of(up, r.randint(1, 3)) + r.choice(["", "-", "."]) + of(dig, r.randint(1, 4)),
            of(up, r.randint(1, 4)) + r.choice("-_/.=") + of(up, r.randint(1, 4)),
            word(1) + of(dig, r.randint(1, 4)) + r.choice(["", ".", "-", "_"]) + word(r.randint(0, 1)),
            word(r.randint(1, 3)) + r.choice([".", "="]) + r.choice([word(1), of(dig, r.randint(1, 3)), of(up, r.randint(1, 3))]),
        ]
    return good, plain


_NUMBER = np.full(129, -1, np.int8)  # class of a code point; 128 stands for all above
for _c in string.ascii_letters + string.digits + MARKS:
    _NUMBER[ord(_c)] = ALPHABET.index(_CLASS.get(_c, _c))
_SPLIT = np.zeros(len(ALPHABET) + 1, bool)  # the last: no class
_SPLIT[[ALPHABET.index(c) for c in SPLITS]] = True


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where `inside` holds."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


class Scanner:
    """Pattern spans, and spans of candidates that credentials' automaton likes better than the ordinary one."""

    def __init__(self, credentials: list[str], ordinary: list[str], alpha: float = ALPHA, evidence: float = EVIDENCE):
        self.good, self.plain = (Automaton([symbols(w) for w in words], alpha) for words in (credentials, ordinary))
        self.tables = self.good.tables(), self.plain.tables()
        self.evidence = evidence

    def score(self, token: str) -> float:
        """Nats by which the token, a string over letters, digits and MARKS, is likelier as a credential."""
        s = symbols(token)
        return self.good.log_likelihood(s) - self.plain.log_likelihood(s)

    def scores(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """score() of many stretches of an array of class numbers, all of them one character on at a time."""
        order = np.argsort(starts - ends, kind="stable")  # long ones first: those that go on are a prefix
        at, length = starts[order], (ends - starts)[order]
        (go, gain, end), (go2, gain2, end2) = self.tables
        s, t, out = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32), np.zeros(len(at))
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k, side="left"))  # of more than k characters
            c = classes[at[:n] + k]
            out[:n] += gain[s[:n], c] - gain2[t[:n], c]
            s[:n], t[:n] = go[s[:n], c], go2[t[:n], c]
        found = np.empty(len(at))
        found[order] = out + end[s] - end2[t]
        return found

    def grammar_spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """By text the candidates with enough evidence: whole runs of letters, digits and marks (without full stops at
        their ends), of any length; of a run that has too little, its parts between SPLITS."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        points = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
        classes = _NUMBER[np.minimum(points, 128)]
        dot = ALPHABET.index(".")
        starts, ends = _runs(classes >= 0)
        while (more := (starts < ends) & (classes[np.minimum(starts, len(classes) - 1)] == dot)).any():
            starts = starts + more
        while (more := (starts < ends) & (classes[np.maximum(ends - 1, 0)] == dot)).any():
            ends = ends - more
        starts, ends = starts[starts < ends], ends[starts < ends]
        hit = self.scores(classes, starts, ends) >= self.evidence
        found = list(zip(starts[hit].tolist(), ends[hit].tolist(), strict=True))
        # parts, of the runs that have any and weren't found whole
        split = _SPLIT[classes]
        before = np.concatenate([[0], np.cumsum(split)])
        open_ = ~hit & (before[ends] > before[starts])
        inner = np.zeros(len(classes) + 1, np.int8)
        np.add.at(inner, starts[open_], 1)
        np.add.at(inner, ends[open_], -1)
        a, b = _runs((np.cumsum(inner[:-1]) > 0) & ~split)
        hit = self.scores(classes, a, b) >= self.evidence
        found += zip(a[hit].tolist(), b[hit].tolist(), strict=True)
        first = np.cumsum(sizes) - sizes
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for x, y in sorted(found):
            k = int(np.searchsorted(first, x, side="right")) - 1
            out[k].append(("grammar", x - int(first[k]), y - int(first[k])))
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """By text all spans by start, then kind: those of the patterns, and of all candidates that the automata find, within
        pattern spans too."""
        return [sorted(base_spans(t) + more, key=lambda x: (x[1], KINDS.index(x[0]))) for t, more in zip(texts, self.grammar_spans(texts), strict=True)]


@cache
def default_scanner() -> Scanner:
    return Scanner(*labelled_credentials())


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and an array of spans (kind, start, end, code points, end exclusive) for every row of docs, by whole text.

    Null texts are empty and have no spans. Ids may be null or repeated, other columns are ignored, an empty
    table gives an empty result. scanner: automata inferred from credentials of your own; None: the default set.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        scan = scanner or default_scanner()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in scan.spans([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("doc_id", id_col)


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the pattern spans, and all spans as text."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), n("grammar"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digests(scan_secrets(table(spark, sf_dir, "documents")))
