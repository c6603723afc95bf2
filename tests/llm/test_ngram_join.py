import random
import re

from sigmill.llm import ngram_join as nj


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    label[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(same) if same and sets[k] else i))
    return sorted(out, key=str)


def texts(seed):
    random.seed(seed)
    vocab = ["".join(random.choices("abcdeé", k=4)) for _ in range(300)]
    out = []
    passage = random.choices(vocab, k=30)
    for _ in range(12):
        base = random.choices(vocab, k=random.choice([3, 8, 40, 90, 200])) + (passage if random.random() < 0.5 else [])
        for _ in range(random.randrange(1, 9)):
            words = list(base)
            for _ in range(random.randrange(1 + len(words) // 25)):
                words[random.randrange(len(words))] = random.choice(vocab)
            if random.random() < 0.3:
                words = words[: -random.randrange(1, 4)] or words
            out.append(" ".join(words))
    out += [" ".join(passage + random.choices(vocab, k=k % 4)) for k in range(20)]
    random.shuffle(out)
    return out


def test_against_brute_force(documents):
    rows = list(enumerate(texts(1)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one TWO"), (5, "a row that repeats an id"), (None, rows[3][1]), (905, rows[7][1]), (906, "w x y z " * 30000)]
    for n, percent in ((4, 85), (5, 80)):
        got = sorted((tuple(r) for r in nj.join(documents(rows), n, percent).collect()), key=str)
        assert got == brute(rows, n, percent)


def test_chains_and_blocks(documents, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 3)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(60)] + [(100 + i, " ".join(words[:60])) for i in range(3)]
    got = sorted((tuple(r) for r in nj.join(documents(rows), 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_empty(documents):
    assert nj.join(documents([])).count() == 0
