"""Plain restatements of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIRST = -(2**63)


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = [x.encode().lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs):
    """docs: (doc_id, text) -> list of (doc_id, n, component, kept)."""
    sets = [shingle_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(docs):
        c = least.get(find(i), d) if sets[i] else d
        out.append((d, len(sets[i]), c, c == d))
    return out


def quality(docs):
    """docs: (doc_id, source, text) -> list of (doc_id, counts..., base_failed, kept, host_rate, reason)."""
    rows = []
    for d, s, t in docs:
        t = t or ""
        w = words(t)
        n = len(w)
        grams = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        covered = {j for i in range(n - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
        failed = {"few_words": n < 50, "repeats": 100 * len(covered) > 50 * n, "symbols": 100 * symbols > 10 * n, "dup_lines": 100 * dup > 30 * len(lines), "word_length": chars > 12 * n or chars < 2 * n}
        rows.append(((d, n, chars, symbols, dup, len(covered)), s, failed))
    rates = defaultdict(dict)
    for rule in ("few_words", "repeats", "symbols", "dup_lines", "word_length"):
        by = defaultdict(list)
        for _, s, failed in rows:
            by[s].append(failed[rule])
        if not rows:
            return []
        m = sum(f[rule] for _, _, f in rows) / len(rows)
        raw = [sum(x) / len(x) for x in by.values()]
        mean = sum(raw) / len(raw)
        v = round(sum((x - mean) ** 2 for x in raw) / len(raw), 12)
        weight = max(1.0, min(1000.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        for s, x in by.items():
            rates[s][rule] = round((sum(x) + m * weight) / (len(x) + weight), 9)
    out = []
    for r, s, failed in rows:
        base = failed["few_words"] or failed["repeats"]
        reason = "base" if base else "host" if max(rates[s].values()) > 0.5 else next((k for k in ("symbols", "dup_lines", "word_length") if failed[k] and rates[s][k] > 0.02), None)
        out.append((*r, base, reason is None, max(rates[s].values()), reason))
    return out


def lines(docs, least=50):
    """docs: (key, text) in reading order, keys distinct -> list of (text, n_lines, n_removed)."""
    seqs = []
    for _, t in docs:
        seqs.append([x for x in (t or "").split("\n") if WORD.search(x)])
    out = []
    for i, (_, t) in enumerate(docs):
        gone = set()
        for s in range(len(seqs[i])):
            for j in range(i + 1):
                for r in range(s if j == i else len(seqs[j])):
                    n = 0
                    while s + n < len(seqs[i]) and r + n < len(seqs[j]) and seqs[i][s + n] == seqs[j][r + n]:
                        n += 1
                    if sum(len(words(x)) for x in seqs[i][s : s + n]) >= least:
                        gone |= set(range(s, s + n))
        kept, k = [], 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                if k not in gone:
                    kept.append(line)
                k += 1
            else:
                kept.append(line)
        out.append((None if t is None else "\n".join(kept), len(seqs[i]), len(gone)))
    return out


def pour(budget, kids):
    """kids: name -> (weight, cap). Give by weight, fill up, give what is left to those that aren't full."""
    got, open_, left = dict.fromkeys(kids, 0.0), set(kids), budget
    while open_ and left > 1e-9:
        total = sum(kids[k][0] for k in open_)
        full = {k for k in open_ if left * kids[k][0] / total >= kids[k][1] - 1e-9}
        if not full:
            for k in open_:
                got[k] = left * kids[k][0] / total
            break
        for k in full:
            got[k] = kids[k][1]
        left -= sum(kids[k][1] for k in full)
        open_ -= full
    return got


def domain(source):
    m = re.search(r"([0-9]{1,9})$", source or "")
    return f"d{int(m[1]) % 4}" if m else "other"


def mix(docs, weights, default, epochs=2, percent=100, seed=17):
    """docs: (doc_id, lang, source, text), ids distinct -> doc_id -> copies."""
    leaves = defaultdict(list)
    for d, lang, source, t in docs:
        leaves[domain(source), lang or "", source or ""].append((d, len(words(t))))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}

    def weight(level, name):
        return float(weights[level].get(name, default[level]))

    def share(prefix, budget):
        level = ("domain", "lang", "source")[len(prefix)]
        kids = defaultdict(float)
        for k, s in supply.items():
            if k[: len(prefix)] == prefix:
                kids[k[len(prefix)]] += s * epochs
        got = pour(budget, {name: (weight(level, name), cap) for name, cap in kids.items()})
        if len(prefix) == 2:
            return {(*prefix, name): g for name, g in got.items()}
        return {k: g for name, x in got.items() for k, g in share((*prefix, name), x).items()}

    out = {}
    for k, target in share((), sum(supply.values()) * percent / 100).items():
        target = math.floor(round(target, 3))
        whole = target // supply[k] if supply[k] else 0
        rest, at = target - whole * supply[k], 0
        for d, n in sorted(leaves[k], key=lambda x: hashlib.md5(f"{seed}:{whole}:{x[0]}".encode()).hexdigest()):
            if whole + (at < rest):
                out[d] = whole + (at < rest)
            at += n
    return out
