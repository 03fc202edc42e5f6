"""Every window of a text against plain loops over words."""

import random

import numpy as np
import pytest

from phasegrid.llm import toxicity
from phasegrid.llm.toxicity import HID, STRIDE, WIDTH


def _gru(net, rows, d):
    """The last state of a plain pass over the input rows."""
    h = np.zeros(HID)
    for x in rows:
        a, u = x @ net.p[f"W{d}"] + net.p[f"b{d}"], h @ net.p[f"U{d}"]
        z, r = (1 / (1 + np.exp(-(a[i * HID : (i + 1) * HID] + u[i * HID : (i + 1) * HID]))) for i in (0, 1))
        n = np.tanh(a[2 * HID :] + r * u[2 * HID :])
        h = z * h + (1 - z) * n
    return h


def plain_logit(net, body):
    x = net.inputs(toxicity._tables([body])).astype(float)
    states = []
    for p in range(len(x)):
        own = p // STRIDE * STRIDE
        states.append(np.r_[_gru(net, x[max(own - STRIDE, 0) : p + 1], "f"), _gru(net, x[p : own + 2 * STRIDE][::-1], "b")])
    best = -np.inf
    for i in range(max(len(x) - WIDTH, 0) + 1):
        held = np.array(states[i : i + WIDTH])
        if not len(held):
            return float(net.p["bo"][0])
        w = np.exp(np.tanh(held @ net.p["Wa"] + net.p["ba"]) @ net.p["va"])
        best = max(best, float((w / w.sum()) @ held @ net.p["wo"] + net.p["bo"][0]))
    return best


def test_all_windows_equal_plain_loops():
    r = random.Random(5)
    net = toxicity.Network(3)
    for name in ("word", "gram"):
        net.p[name] *= 30
    net.p["bo"][0] = 0.3
    bodies = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 7))) for _ in range(n)).encode() for n in (0, 1, 15, 16, 17, 31, 32, 33, 48, 49, 130)]
    bodies += [b"   ", b"", "é \u0000 x".encode()]
    got = net.text_logits(toxicity._tables(bodies))
    assert got == pytest.approx([plain_logit(net, b) for b in bodies], abs=1e-5)
    order = list(range(len(bodies)))
    r.shuffle(order)
    assert net.text_logits(toxicity._tables([bodies[i] for i in order])) == pytest.approx(got[order], abs=1e-6)
    assert len(net.text_logits(toxicity._tables([]))) == 0


def test_a_passage_is_found_at_any_word():
    net = toxicity.Network(3)
    for name in ("word", "gram"):
        net.p[name] *= 30
    passage = " ".join(f"w{i}" for i in range(WIDTH))
    logits = net.text_logits(toxicity._tables([" ".join(["filler"] * k + [passage] + ["filler"] * (100 - k)).encode() for k in range(20)]))
    assert np.isfinite(logits).all() and logits.std() < 0.25 * abs(net.text_logits(toxicity._tables([passage.encode()]))[0] - net.text_logits(toxicity._tables([b"filler"]))[0]) + 0.5
