"""Models against plain versions, and long or odd inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brandlens.llm import chat_format, html_text, language_id, toxicity
from brandlens.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_grams(text):
    """The hashed n-grams of a text, one set for each spectrum, character by character."""
    low = text.lower() + "\0\0"
    codes = [ord(c) if c.isalpha() or c == "\0" else 32 for c in low]
    out = []
    for n, bits in language_id.SPECTRA:
        found = set()
        for i in range(len(low) - 2):
            h = codes[i] * 0x9E3779B1 % 2**32
            for k, m in zip(range(1, n), (0x85EBCA77, 0xC2B2AE3D), strict=False):
                h = ((h << 5 | h >> 27) % 2**32) ^ codes[i + k] * m % 2**32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            found.add(h >> 32 - bits)
        out.append(found)
    return out


def plain_kernel(a, b):
    return sum(len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(a, b, strict=True)) / len(a)


def test_language_scores_equal_the_explicit_kernel_machine():
    docs = pd.read_parquet(f"{DATA}/documents.parquet").dropna(subset=["text", "lang"]).head(60)
    texts = [t[:400] for t in docs.text]
    labels = docs.lang.tolist()
    packed = np.concatenate([np.packbits(bits, axis=1) for bits, _ in language_id.presence(texts)])
    model = language_id.fit_kernel_ridge(packed, labels, landmarks=40, ridge=1e-2)
    languages = sorted(set(labels))
    sets = [plain_grams(t) for t in texts]
    y = np.array([languages.index(x) for x in labels])
    chosen = [i for c in range(len(languages)) for i in np.flatnonzero(y == c)[: 40 // len(languages)]]
    kernel = np.array([[plain_kernel(a, sets[j]) for j in chosen] for a in sets])
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors[:, values > 1e-5] / np.sqrt(values[values > 1e-5])
    z = np.hstack([kernel @ root, np.ones((len(sets), 1))])
    weight = 1 / np.bincount(y)[y] / len(languages)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    penalty = 1e-2 * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    w = np.linalg.solve(z.T @ (z * weight[:, None]) + penalty + 1e-12 * np.eye(len(penalty)), z.T @ (target * weight[:, None]))
    got = np.concatenate([model.scores(bits) for bits, _ in language_id.presence(texts)])
    assert np.abs(got - z @ w).max() < 2e-3
    assert (got.argmax(axis=1) == (z @ w).argmax(axis=1)).all()


def test_presence_of_a_text_does_not_depend_on_its_neighbours():
    texts = ["", "one text", "another", "x", "dernier"]
    together = np.concatenate([bits for bits, _ in language_id.presence(texts)])
    assert (together == np.concatenate([next(language_id.presence([t]))[0] for t in texts])).all()


def test_no_language_is_left_out(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * k + i, f"l{k}", " ".join((letters[k % 26] + letters[(k * 7 + j) % 26] + letters[k // 26]) * 2 for j in range(12))) for k in range(80) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = language_id.train_language_model(docs)
    assert len(model.languages) == 80
    small = language_id.train_language_model(docs, most_texts=160)
    assert len(small.languages) == 80
    out = language_id.predict_language(docs, model)
    assert out.where("lang = lang_pred").count() > 0.9 * len(rows)


def plain_ftrl(rows, labels, prior, min_texts, alpha=1.0, beta=1.0, l1=4.0, l2=1.0, epochs=8):
    seen = {}
    for row in rows:
        for i in row:
            seen[i] = seen.get(i, 0) + 1
    z, n, zb, nb, bias = {}, {}, 0.0, 0.0, 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            own = [i for i in row if seen[i] >= min_texts]
            w = {i: weight(i) for i in own}
            bias = -zb / ((beta + math.sqrt(nb)) / alpha + 1e-6)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()) + bias)))) - y
            for i in own:
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias
            nb += g * g
    share = sum(labels) / len(labels)
    return {i: weight(i) for i in z if weight(i)}, bias + math.log(prior / (1 - prior)) - math.log(share / (1 - share))


def feature_sets(texts):
    out = []
    for rows, found, owner in toxicity.features(texts):
        out += [set(found[owner == k].tolist()) for k in range(rows)]
    return out


def test_toxicity_scores_equal_a_plain_loop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    ids = "crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0"
    known = labels.where(f"toxic IS NOT NULL AND {ids}")
    share = known.agg(F.avg("toxic")).first()[0]
    learnt = docs.join(known.select("doc_id", "toxic"), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("key")).orderBy("key").collect()
    weights, bias = plain_ftrl(feature_sets([r.text for r in learnt]), [float(r.toxic) for r in learnt], share, 3)
    rows = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, DATA).collect()}
    every = docs.collect()
    for r, found in zip(every, feature_sets([r.text for r in every]), strict=True):
        logit = sum(weights.get(i, 0.0) for i in found) + bias
        assert rows[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, logit)))), abs=1e-6)


def test_toxicity_sample_is_bounded_in_features(spark):
    word = lambda i: f"word{i}"
    rows = [(i, " ".join(word(j) for j in range(300)) + (" vile" if i % 2 else " kind"), "clash") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, toxic_score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(61, None), (None, 1)], "doc_id bigint, toxic int")
    few = toxicity.train_toxicity_model(docs, labels, most_features=4 * 1800)
    assert len(few.index) <= len(toxicity.train_toxicity_model(docs, labels).index)
    out = toxicity.score_toxicity(docs, toxicity.train_toxicity_model(docs, labels))
    assert out.count() == 65 and out.columns.count("toxic_score") == 1
    assert toxicity.train_toxicity_model(docs, labels.limit(0)).index.size == 0


def test_conversation_of_many_turns(spark):
    n = 20_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id < 9000 THEN 'user' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('[x] ', id, ' é|<') AS text")
    chats = chat_format.format_chats(turns)
    row = chats.select(F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").first()
    assert row.n == n and row.loss == "".join(f"[x] {i} é|<" for i in range(9001, n, 2))
    first = row.loss_spans[0]
    assert chat_format.unescape(F.lit("")) is not None and row.formatted[first.start : first.start + first.length] == "&lbr;x] 9001 é&bar;&lt;"


def test_elements_inside_sentences_are_read():
    read = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert read("<p>where <math><mi>x</mi></math> is <svg><title>t</title><text>label</text></svg> now</p>") == ["where x is label now"]
    assert read("<p>a <object>b</object> <video>c</video> <canvas>d</canvas></p><noscript>e</noscript><template>f</template><iframe>g</iframe>") == ["a b c d", "e", "f", "g"]
    assert read("<svg><p>after an open one</p><div>x</div>") == ["after an open one", "x"]
    assert read("<svg/><p>x</p><script>no</script><style>no</style><textarea>no</textarea><button>no</button><select><option>no</select>") == ["x"]


def test_very_long_page():
    page = "<div>" * 20_000 + "<p>" + "word " * 200_000 + "</p>" + "<p>x</p>" * 30_000
    assert len(html_text.blocks_of(page)) == 30_001
