"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (email, ip, card, phone). The field then labels the tokens of every document that hold a
digit or an at sign, with one of these kinds, ``secret`` (keys and passwords) or none. Neighbours in the text share
chain potentials; distant tokens share skip potentials if they are equal (letters and digits, whatever their
punctuation or case) or similar (the same last seven digits, the same local part of an address, one edit). Each
token is linked to the last one before it that is equal, and to the last ones that are similar, so links grow with the
tokens. Loopy sum-product messages spread labels along all links, and tokens that come out as an entity without a base
span become added spans. Base spans always stay.

What a token shows of itself is its shape and the label a pattern gives it: base spans, and for secrets a name
such as ``token =`` before a long value. All weights (shapes, pattern labels, chain, skip) are learned together by
pseudo-likelihood on a bounded sample of documents (``sample_docs`` that have a digit or an at sign, first by hash, and
``sample_tokens`` of their tokens). Each token counts twice, with its pattern's label visible and, by a smaller
weight (``HIDDEN``), invisible, so the field learns what an entity looks like that no pattern sees.

Defined results: a null text is an empty text and has no spans; texts count whole, and every pattern takes time in
proportion to the text, whatever it holds; equal texts have equal spans; repeated rows repeat them; positions are
code points, ends exclusive; n_<kind> count base spans, n_added the field's, n_spans both; spans may name ``secret`` as
a fifth kind, last in order; other columns pass through, but for those named like the results.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdrspark.llm.common import from_texts

#: The kinds of base spans, in the order in which spans with one start are listed, and the field's own; its label 0 is "none".
KINDS = ("email", "ip", "card", "phone")
LABELLED = (*KINDS, "secret")
Span = tuple[int, int, int]  # start, kind, end

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")

# -- base spans -----------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign leftwards: a local part has no at sign, so each sign belongs to one possible match."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        # Without a match, what lies before the sign can't be part of a later one.
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Runs of numbers joined by single dots, four at a time from the left."""
    out = []
    for m in NUMBERS.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]


def base_spans(text: str) -> list[Span]:
    if not CANDIDATE.search(text):
        return []
    found = (emails(text), addresses(text), cards(text), phones(text) if "+" in text else [])
    return sorted((s, k, e) for k, spans in enumerate(found) for s, e in spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{LABELLED[k]}:{s}:{e}" for s, k, e in spans)


# -- the field ------------------------------------------------------------------------------

FEATURES = (
    "one", "at", "dot_after_at", "plus", "bracket", "hyphen", "three_dots", "letters", "only_digits",
    "digits_1_3", "digits_4_6", "digits_7_9", "digits_10_13", "digits_14_19", "digits_20_up", "colon_or_slash",
    "long_mixed", "assigned",
)
LABELS = 1 + len(LABELLED)
SECRET = LABELS - 1
#: Letters and digits that a token must have for a skip link; those that a secret must have; digits that link two numbers.
LINKED_CHARS, SECRET_CHARS, LINKED_DIGITS = 4, 16, 7
#: How often the patterns are taken to miss an entity; links between equal and between similar tokens of each kind that are assumed.
HIDDEN, ASSUMED = 0.2, 20
#: Digits that an added span must have, by kind.
LEAST_DIGITS = {"ip": 4, "card": 12, "phone": LINKED_DIGITS}
NAMED = r"(?:token|secret|password|passwd|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?"
ASSIGNED = re.compile(r"[:=]\s*[\"']?$")
NAMED_BEFORE = re.compile(NAMED + r"\s*[:=]\s*[\"']?$", re.IGNORECASE)
NAMED_INSIDE = re.compile(r"[\"']?" + NAMED + r"[:=][\"']?", re.IGNORECASE)
NOT_DIGITS = re.compile(r"[^0-9]+")


def shape(token: str, key: str, digits: int, before: str) -> tuple[bool, ...]:
    """FEATURES of a token; key has its letters and digits, before is the end of the text before it."""
    at, behind = token.find("@"), token[token.find("@") + 1 :]
    inner = token.strip(".,")
    return (
        True, at >= 0, at >= 0 and "." in behind, token[0] == "+", "(" in token or ")" in token, "-" in token,
        inner.count(".") == 3, not key.isdigit(), inner.isdigit(),
        1 <= digits <= 3, 4 <= digits <= 6, 7 <= digits <= 9, 10 <= digits <= 13, 14 <= digits <= 19, digits >= 20, ":" in token or "/" in token,
        len(key) >= SECRET_CHARS and digits > 0 and not key.isdigit() and at < 0, ASSIGNED.search(before) is not None,
    )


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, removed or exchanged character makes one string the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


@dataclass
class Graph:
    """Tokens of several documents: their places, shapes (numbers of rows of x), the labels that patterns give, links between them."""

    doc: np.ndarray
    span: np.ndarray  # (tokens, 2)
    x: np.ndarray  # (different shapes, features)
    shape: np.ndarray
    seen: np.ndarray
    chain: np.ndarray  # (links, 2)
    equal: np.ndarray
    similar: np.ndarray


def graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    doc, place, of, seen, chain, equal, similar = (array("q") for _ in range(7))
    shapes: dict[tuple[bool, ...], int] = {}
    for d, (text, own) in enumerate(zip(texts, spans, strict=True)):
        if not CANDIDATE.search(text):
            continue
        label_at = sorted((s, e, k + 1) for s, k, e in own)
        next_span, open_spans, last = 0, [], -2
        met: dict[object, int] = {}
        keys: dict[int, str] = {}
        for index, m in enumerate(TOKEN.finditer(text)):
            token = m[0]
            if not CANDIDATE.search(token):
                continue
            s, e = m.span()
            while next_span < len(label_at) and label_at[next_span][0] < e:
                open_spans.append(label_at[next_span])
                next_span += 1
            open_spans = [o for o in open_spans if o[1] > s]
            node = len(doc)
            key = "".join(filter(str.isalnum, token.lower()))
            digits = NOT_DIGITS.sub("", token)
            before = text[max(0, s - 40) : s]
            row = shape(token, key, len(digits), before)
            label = open_spans[0][2] if open_spans else 0
            if not label and row[-2] and (NAMED_BEFORE.search(before) or NAMED_INSIDE.match(token)):
                label = SECRET
            doc.append(d)
            place.extend((s, e))
            of.append(shapes.setdefault(row, len(shapes)))
            seen.append(label)
            if last == index - 1:
                chain.extend((node - 1, node))
            last = index
            if len(key) >= LINKED_CHARS:
                same = met.get(key)
                if same is not None:
                    equal.extend((same, node))
                for name in _nearly(token, key, digits):
                    other = met.get(name)
                    if other is not None and other != same and keys[other] != key and (name[0] not in "<>" or one_edit(keys[other], key)):
                        similar.extend((other, node))
                    met[name] = node
                met[key] = node
                keys[node] = key
    links = lambda v: np.array(v, np.int64).reshape(-1, 2)
    whole = lambda v: np.array(v, np.int64)
    x = np.array(list(shapes), np.float64).reshape(-1, len(FEATURES))
    return Graph(whole(doc), links(place), x, whole(of), whole(seen), links(chain), links(equal), np.unique(links(similar), axis=0))


def _nearly(token: str, key: str, digits: str) -> list[tuple[str, str]]:
    """Under which names a token is met by similar ones: its last digits, its local part, and (one edit leaves one of them
    as it is) the first and the last few characters."""
    out = []
    at = token.find("@")
    if at >= LINKED_CHARS:
        out.append(("@", token[:at].lower().lstrip("\"'<([")))
    elif len(digits) >= LINKED_DIGITS and key.isdigit():
        out.append(("0", digits[-LINKED_DIGITS:]))
    if len(key) >= 2 * LINKED_CHARS:
        few = 2 * LINKED_CHARS if len(key) >= 4 * LINKED_CHARS + 1 else LINKED_CHARS
        out += [("<", key[:few]), (">", key[-few:])]
    return out


@dataclass
class Field:
    """Log potentials: of shapes (features x labels), of what a pattern says (label or none x labels), and of label pairs
    along chain links and links between equal and between similar tokens."""

    unary: np.ndarray
    pattern: np.ndarray
    chain: np.ndarray
    equal: np.ndarray
    similar: np.ndarray

    def own(self, g: Graph) -> np.ndarray:
        return (g.x @ self.unary)[g.shape] + self.pattern[g.seen]

    def marginals(self, g: Graph, rounds: int = 10, damping: float = 0.3, together: int = 100_000) -> np.ndarray:
        """Label probabilities of every token by loopy sum-product messages, all links at once (in parts of `together`)."""
        own = self.own(g).astype(np.float32)
        links = np.concatenate([g.chain, g.equal, g.similar])
        kind = np.repeat(np.arange(3), [len(g.chain), len(g.equal), len(g.similar)])
        pairs = np.stack([self.chain, self.equal, self.similar]).astype(np.float32)
        # Messages run both ways: from links[:, 0] first, then from links[:, 1] with transposed potentials.
        source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        pairs = np.concatenate([pairs, pairs.transpose(0, 2, 1)])
        kind = np.concatenate([kind, kind + 3])
        message = np.zeros((len(source), LABELS), np.float32)
        belief = own.copy()
        for _ in range(rounds if len(links) else 0):
            new = np.empty_like(message)
            back = np.roll(np.arange(len(source)), len(links))
            for lo in range(0, len(source), together):
                part = slice(lo, lo + together)
                given = (belief[source[part]] - message[back[part]])[:, :, None] + pairs[kind[part]]
                top = given.max(axis=1)
                new[part] = top + np.log(np.exp(given - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = damping * message + (1 - damping) * new
            belief = own.copy()
            np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _numbered() -> tuple[dict[str, np.ndarray], int]:
    """For each table of a Field the numbers of its weights in one vector; a table of skip links has two different ones."""
    unary = np.arange(len(FEATURES) * LABELS).reshape(len(FEATURES), LABELS)
    pattern = unary.size + np.arange(LABELS * LABELS).reshape(LABELS, LABELS)
    chain = pattern.max() + 1 + np.arange(LABELS * LABELS).reshape(LABELS, LABELS)
    # Links only tell agreement from difference: repeats of what nobody knows must not talk each other into a label.
    agree = 1 - np.eye(LABELS, dtype=np.int64)
    equal = chain.max() + 1 + agree
    similar = equal.max() + 1 + agree
    return {"unary": unary, "pattern": pattern, "chain": chain, "equal": equal, "similar": similar}, int(similar.max()) + 1


def learn(texts: list[str], sample_tokens: int = 20_000, decay: float = 0.02, most_steps: int = 30) -> Field:
    """Potentials from texts and what the patterns say of them, by pseudo-likelihood: a token's label given its own
    looks and the labels of all linked tokens. Newton steps on a convex function; decay is the weight of the squares.

    Linked tokens of which the patterns see only one are rare in a sample, so an invisible entity is also shown with one more link
    to a token of its label; ASSUMED links of each kind between equal and between similar tokens are added, and as many long values without a name that are no secrets (digests, numbers of versions)."""
    g = graph(texts, [base_spans(t) for t in texts])
    number, count = _numbered()
    truth = g.seen
    chosen = np.arange(len(truth))
    if len(chosen) > sample_tokens:
        chosen = np.sort(np.random.default_rng(1).choice(chosen, sample_tokens, replace=False))
    # What each token's neighbours add to its labels' scores, as rows of weight numbers.
    around: list[list[np.ndarray]] = [[] for _ in range(len(truth))]
    for name, links in (("chain", g.chain), ("equal", g.equal), ("similar", g.similar)):
        for u, v in links.tolist():
            around[v].append(number[name][truth[u]])
            around[u].append(number[name][:, truth[v]])
    rows: list[tuple[np.ndarray, int, float]] = []  # numbers of each label's weights, label, weight of the row
    for i in chosen.tolist():
        shown = [number["unary"][k] for k in np.flatnonzero(g.x[g.shape[i]])] + around[i]
        label = int(truth[i])
        rows.append((np.stack([*shown, number["pattern"][label]]), label, 1 - HIDDEN if label else 1.0))
        if label:
            rows.append((np.stack([*shown, number["pattern"][0]]), label, HIDDEN))
            rows += [(np.stack([*shown, number["pattern"][0], number[name][label]]), label, HIDDEN) for name in ("equal", "similar")]
    for label in range(LABELS):
        rows += [(np.stack([number["pattern"][0], number[name][label]]), label, float(ASSUMED)) for name in ("equal", "similar")]
    digest = np.flatnonzero([f in ("one", "letters", "digits_20_up", "long_mixed") for f in FEATURES])
    rows.append((np.stack([*number["unary"][digest], number["pattern"][0]]), 0, 2.0 * ASSUMED))
    rows.append((np.stack([*number["unary"][digest], number["pattern"][0], number["equal"][SECRET]]), SECRET, float(ASSUMED)))
    theta = np.zeros(count)
    at = np.stack([np.bincount(r[0][:, a], minlength=count) for r in rows for a in range(LABELS)]).reshape(len(rows), LABELS, count).astype(np.float32) if len(rows) * count * LABELS < 2e7 else None

    def design(lo: int, hi: int) -> np.ndarray:
        if at is not None:
            return at[lo:hi]
        return np.stack([np.bincount(r[0][:, a], minlength=count) for r in rows[lo:hi] for a in range(LABELS)]).reshape(hi - lo, LABELS, count).astype(np.float32)

    label, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def value(theta: np.ndarray, steep: bool) -> tuple[float, np.ndarray, np.ndarray]:
        total, slope, bend = 0.5 * decay * float(theta @ theta), decay * theta, decay * np.eye(count)
        for lo in range(0, len(rows), 1000):
            hi = min(len(rows), lo + 1000)
            phi = design(lo, hi).astype(np.float64)
            score = phi @ theta
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(axis=1, keepdims=True)
            w, y = weight[lo:hi], label[lo:hi]
            total -= float(w @ np.log(np.maximum(p[np.arange(hi - lo), y], 1e-300)))
            if steep:
                mean = np.einsum("nl,nlk->nk", p, phi)
                slope = slope + w @ (mean - phi[np.arange(hi - lo), y])
                wide = (phi * np.sqrt(w[:, None] * p)[:, :, None]).reshape(-1, count)
                bend = bend + wide.T @ wide - (mean * w[:, None]).T @ mean
        return total, slope, bend

    now, slope, bend = value(theta, True)
    for _ in range(most_steps):
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-4 and value(theta - size * step, False)[0] > now:
            size /= 2
        theta = theta - size * step
        before, (now, slope, bend) = now, value(theta, True)
        if before - now < 1e-4:
            break
    return Field(**{name: theta[numbers] for name, numbers in number.items()})


def added_spans(text: str, place: np.ndarray, seen: np.ndarray, label: np.ndarray, likely: np.ndarray) -> list[Span]:
    """Runs of neighbouring tokens with one label and no base span, without outer punctuation. A run has a token that has
    the label surely, and beside it those that have it likely."""
    out, done = [], 0
    free = (seen == 0) | (seen == SECRET)
    next_to = lambda i: not text[place[i][1] : place[i + 1][0]].strip()
    for at in np.flatnonzero((label > 0) & free).tolist():
        if at < done:
            continue
        i, j = at, at + 1
        while i > done and likely[i - 1] == label[at] and free[i - 1] and next_to(i - 1):
            i -= 1
        while j < len(label) and likely[j] == label[at] and free[j] and next_to(j - 1):
            j += 1
        done = j
        kind = LABELLED[label[at] - 1]
        s, e = int(place[i][0]), int(place[j - 1][1])
        if kind == "secret" and (m := NAMED_INSIDE.match(text[s:e])):
            s += m.end()
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while s < e and not (text[e - 1].isalnum() or text[e - 1] == ")"):
            e -= 1
        digits = len(NOT_DIGITS.sub("", text[s:e]))
        if s < e and digits >= LEAST_DIGITS.get(kind, 0) and (kind != "email" or "@" in text[s:e]):
            out.append((s, int(label[at]) - 1, e))
    return out


def find(texts: list[str], field: Field, least: float = 0.9, likely: float = 0.5) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and the spans that the field adds."""
    base = [base_spans(t) for t in texts]
    g = graph(texts, base)
    added: list[list[Span]] = [[] for _ in texts]
    if len(g.doc):
        p = field.marginals(g)
        best, top = p.argmax(axis=1), p.max(axis=1)
        label, near = np.where(top >= least, best, 0), np.where(top >= likely, best, 0)
        docs, edge = np.unique(g.doc, return_index=True)
        for i, lo, hi in zip(docs.tolist(), edge.tolist(), [*edge[1:].tolist(), len(label)], strict=True):
            part = slice(lo, hi)
            if (label[part].astype(bool) & ((g.seen[part] == 0) | (g.seen[part] == SECRET))).any():
                added[i] = added_spans(texts[i], g.span[part], g.seen[part], label[part], near[part])
    return list(zip(base, added, strict=True))


def sample(docs: DataFrame, sample_docs: int = 400, spare: int = 16) -> list[str]:
    """Different texts that have a digit or an at sign, the first by hash, sample_docs at most. Only about spare times
    as many different ones, a hash share of them, are looked at, so that little moves however many there are."""
    some, h = docs.filter(F.col("text").rlike("[0-9@]")), F.xxhash64("text")
    count = some.agg(F.approx_count_distinct(h)).first()[0]
    share = min(1.0, spare * sample_docs / max(1, count))
    rows = some.filter(F.pmod(h, F.lit(2**30)) < F.lit(int(share * 2**30)))
    rows = rows.select("text", F.xxhash64("text").alias("h")).distinct()
    return [r["text"] for r in rows.orderBy("h", "text").limit(sample_docs).collect()]


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """docs without text, with base counts by kind, base_sha256, spans (base and added), n_added, n_spans."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    made = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string", "n_added": "long", "n_spans": "long"}

    def start():
        model = sent.value

        def run(texts: list) -> dict[str, list]:
            found = find([t or "" for t in texts], model)
            out = {f"n_{k}": [sum(s[1] == i for s in b) for b, _ in found] for i, k in enumerate(KINDS)}
            out["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
            out["spans"] = [joined(sorted(b + a)) for b, a in found]
            out["n_added"] = [len(a) for _, a in found]
            out["n_spans"] = [len(b) + len(a) for b, a in found]
            return out

        return run

    return from_texts(docs, made, start)


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return detect(docs, learn(sample(docs)))
