import hashlib
import random
import re

import numpy as np

from rankweave.llm import pii


def scanned(t):
    """The patterns, as regular expressions scan for them."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_a_scan():
    rng = random.Random(1)
    for _ in range(6000):
        t = "".join(rng.choices("a@@..-+1234 (%9é", k=rng.randint(1, 40)))
        assert sorted(pii.base_spans(t)) == scanned(t), t


def test_base_spans_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000):
        assert len(pii.base_spans(t)) <= len(t)


def whole_viterbi(field, words):
    keys = [field.key(pii.features(w)) for w in words]
    own, left, right = field.tables
    scores = [own[k] + left[keys[i - 1] if i else 0] + right[keys[i + 1] if i + 1 < len(keys) else 0] for i, k in enumerate(keys)]
    best, back = scores[0], []
    for s in scores[1:]:
        paths = best[:, None] + field.moves
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + s
    labels = [int(best.argmax())]
    for b in reversed(back):
        labels.append(int(b[labels[-1]]))
    return labels[::-1], keys


def test_field_learns_its_table_and_runs_decode_as_a_whole():
    field, right, total = pii.trained_field(), 0, 0
    rng = random.Random(2)
    rows = pii.training_table()
    for words, labels in rows:
        longer = words + [w for k in range(rng.randint(0, 4)) for w in rng.choice(rows)[0]]
        expected, keys = whole_viterbi(field, longer)
        first = np.zeros(len(keys), bool)
        first[0] = True
        assert field.decode(np.array(keys), first).tolist() == expected
        right += sum(a == b for a, b in zip(whole_viterbi(field, words)[0], labels))
        total += len(labels)
    assert right / total > 0.98


def test_field_adds_spans():
    cases = {"write to anna (at) example (dot) com please": "anna (at) example (dot) com", "phone (555) 123-4567 now": "(555) 123-4567", "ip 2001:db8:1::7 ok": "2001:db8:1::7", "we met at the dot on page 12.": None}
    for text, span in cases.items():
        base, every = pii.find_spans([text], pii.trained_field())[0]
        assert base == [] and [text[s:e] for _, s, e in every] == ([span] if span else [])


def test_query_matches_brute_force(docs):
    texts = {}
    for d in docs.collect():
        texts.setdefault(d.doc_id, set()).add(d.text or "")
    for r in pii.detect(docs).collect():
        expected = set()
        for t in texts[r.doc_id]:
            base = scanned(t)
            listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
            expected.add((*(sum(x[0] == k for x in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) in expected
    assert max(r.n_email + r.n_ip + r.n_card + r.n_phone for r in pii.detect(docs).collect()) == 4


def test_redact(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    clean = next(r for r in out.collect() if r.text and r.text.startswith("write to ["))
    assert clean.text == "write to [EMAIL] or [PHONE] from [IP] card [CARD] éè" and clean.n_chars == len(clean.text)


def test_empty(none):
    assert pii.detect(none).count() == 0 and pii.redact(none).count() == 0


def test_long_white_space_takes_linear_time():
    import time

    began = time.time()
    assert pii.plausible(0, "john at example dot com") and pii.plausible(0, "john\n at \t example  dot com")
    pii.plausible(0, "john at" + " " * 2_000_000 + "example dot com")
    assert time.time() - began < 5
