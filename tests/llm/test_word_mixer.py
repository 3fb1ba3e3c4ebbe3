import random
import zlib

import numpy as np

from tamis.llm import context_mixing as cm


def test_word_mixer_is_a_distribution_over_codes():
    rng = np.random.default_rng(3)
    mixer = cm.Mixer(rng.integers(0, 9, (cm.SLOTS, 2)).astype(np.float32), rng.integers(0, 5, cm.GATES * cm.CODES).astype(np.float32))
    before = rng.integers(0, 1 << 32, 40).astype(np.uint32) & np.uint32(0xFFFFFFF8)
    texts = np.tile(np.append(before, np.uint32(0)), (cm.CODES, 1))
    texts[:, -1] = np.arange(cm.CODES, dtype=np.uint32) << 20
    run = cm.run_of(texts.ravel(), np.full(cm.CODES, texts.shape[1]))
    logs = mixer.log_probabilities(run, cm.CODES, np.ones(texts.size, bool)).reshape(texts.shape)
    assert abs(np.exp(logs[:, -1]).sum() - 1) < 1e-4
    assert np.ptp(logs[:, :-1], axis=0).max() == 0  # what follows a token does not change its prediction


def test_context_counts_hold_all_training_tokens_and_stop_at_texts():
    marks = np.array([cm.mark_of(w) for w in (b"alpha", b"beta", b"gamma")], np.uint32)
    contexts = cm.Contexts()
    contexts.add(marks[[0, 1, 0, 1, 2]], np.array([2, 3]))
    run = cm.run_of(marks[[0, 1, 2]], np.array([3]))
    code = cm.code_of(run.marks)
    slots, bits = cm.code_slots(run.keys, code), cm.BITS[:, code]
    seen = contexts.table.reshape(-1, 2)[slots[0, 0], bits[0]]
    assert seen.tolist()[1:] == [2, 1] and contexts.gated.sum() == 5 and contexts.table.sum() == 5 * 2 * cm.CODE_BITS
    # the second text's first word has no word before it, as in the first text
    assert contexts.table.reshape(-1, 2)[slots[1, 0, 0], bits[0, 0]] == 2
    for number, packed in contexts.slices():
        assert cm._released(packed).sum() > 0 and number < 0


def test_gates_follow_the_short_words_of_a_text():
    classes = np.array([2, -1, 1, 1, -1, -1, 3, -1, 0])
    assert cm.gates_of(classes, np.array([0, 0, 0, 0, 0, 1, 1, 1, 1]), 3).tolist() == [8, 2, 2, 1, 1, 8, 8, 3, 3]
    assert cm.gates_of(np.array([-1, -1]), np.array([0, 1]), 2).tolist() == [8, 8]


def test_known_words_are_predicted_by_the_words_before(spark):
    chance = random.Random(5)
    names = [f"word{i:03d}" for i in range(60)]
    follows = {w: chance.sample(names, 3) for w in names}

    def text() -> str:
        words = [chance.choice(names)]
        while len(words) < 80:
            words.append(chance.choice(follows[words[-1]]))
        return " ".join(words)

    rows = [(i, text()) for i in range(150)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    # the same held-out words in another order; the ids are held out too
    others = [j for j in range(1000, 3000) if zlib.crc32(str(j).encode()) % 5 == 1][: len(held)]
    texts = dict(rows)
    rows += [(j, " ".join(chance.sample(texts[i].split(), 80))) for i, j in zip(held, others)]
    scores = {r["doc_id"]: r["score"] for r in cm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    better = sum(scores[i] > scores[j] + 10 for i, j in zip(held, others))
    assert len(held) > 20 and better == len(held)
