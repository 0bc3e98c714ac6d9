"""Plain versions, letter by letter, of what the operators compute; written on their own from the definition."""

from collections import Counter

PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}


def rc(s):
    return "".join(PAIR[c] for c in reversed(s))


def canon(s):
    return min(s, rc(s)) if all(c in PAIR for c in s) else None


def enc(s):
    return "".join("A" if c in "NWKSYMR" else c for c in s)


def grams(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def counts(seqs, k):
    n = Counter(canon(g) for s in seqs if s is not None for g in grams(enc(s), k))
    n.pop(None, None)
    return {g: min(c, 255) for g, c in n.items()}


def correct(seq, spectrum, k):
    """The whole correction of one read against {canonical k-mer: multiplicity}."""
    mult = lambda g: spectrum.get(canon(g), 0) if len(g) == k else 0
    read = list(seq)
    if len(read) < k:
        return seq

    def options(g, i):
        forward = canon(g) is not None and g < rc(g) or canon(g) is None
        found = [(b, mult(g[:i] + b + g[i + 1 :])) for b in ("ACGT" if forward else "TGCA") if b != g[i]]
        return [(b, m) for b, m in found if m]

    def passes(nerr, dist, ping):
        text = enc(read)
        starts = range(len(text) - k + 1)
        hit = [mult(text[i : i + k]) > 0 for i in starts]
        solid = [any(hit[j] for j in range(max(0, t - k + 1), min(t, len(hit) - 1) + 1)) for t in range(len(text))]
        if all(solid):
            return None
        regions = []
        for i in starts:
            if hit[i] and (i == 0 or not hit[i - 1]):
                regions.append([i, i])
            elif hit[i]:
                regions[-1][1] = i
        regions.sort(key=lambda r: (r[1] - r[0]) * (-1 if ping else 1))
        log = []
        for lo, hi in regions:
            work, first_right = list(text), None
            for right in (True, False):
                last, n, mine = (None if right else first_right), 0, []
                for s in range(hi + 1, len(text) - k + 1) if right else range(lo - 1, -1, -1):
                    t = s + k - 1 if right else s
                    if solid[t]:
                        break
                    g = "".join(work[s : s + k])
                    if mult(g):
                        continue
                    opts = options(g, k - 1 if right else 0)
                    if len(opts) > 1:
                        ok = []
                        for b, m in opts:
                            w = work[:t] + [b] + work[t + 1 :]
                            if right:
                                rest = len(w) - s - 1
                                near = [] if rest < k else [s + 1 + i for i in range(min(rest - k, dist - 1) + 1)]
                            else:
                                near = [] if t - 1 <= 0 else list(range(t - 2, max(0, t - 1 - dist) - 1, -1))
                            if all(mult("".join(w[i : i + k])) for i in near):
                                ok.append((b, m))
                        top = max((m for _, m in ok), default=0)
                        opts = [next(x for x in ok if x[1] == top)] if ok else []
                    if not opts:
                        break
                    work[t] = opts[0][0]
                    mine.append((t, opts[0][0]))
                    if right and first_right is None:
                        first_right = t
                    if last is None:
                        last = t
                    if abs(t - last) < k:
                        n += 1
                        if n > nerr:
                            mine = mine[: len(mine) - n]
                            break
                    else:
                        last, n = t, 0
                log += mine
        return log

    for nerr in range(1, 5):
        for ping in (True, False):
            log = passes(nerr, 5 - nerr, ping)
            if log is None:
                return "".join(read)
            if not log:
                break
            for t, b in log:
                read[t] = b
        votes, text = Counter(), enc(read)
        for i, g in enumerate(grams(text, k)):
            if not mult(g):
                for j in range(k):
                    for b in "ACGT":
                        if b != g[j] and mult(g[:j] + b + g[j + 1 :]):
                            votes[i + j, b] += 1
        if not votes:
            break
        most = max(votes.values())
        if most >= 3:
            for t in {t for t, _ in votes}:
                tied = sorted(b for b in "ACGT" if votes.get((t, b)) == most)
                if tied and len(tied) != 2:
                    read[t] = tied[-1]
    return "".join(read)
