"""Recognised blocks fused and set in grids, against plain walks."""

import random

from costbook.operators import pages as P

SCHEMA = "doc string, page long, line_no long, x1 double, y1 double, x2 double, y2 double, text string, confidence double, pass_label string"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda s: (s[2] - s[0]) * (s[3] - s[1])
    return w * h / (area(a) + area(b) - w * h)


def test_fusion_keeps_the_first_box(spark):
    dice = random.Random(4)
    blocks = []
    for k in range(60):
        x, y = dice.randrange(6) * 50.0 + dice.randrange(6), dice.randrange(4) * 30.0 + dice.randrange(4)
        blocks.append(("d", k % 2, k, x, y, x + 40, y + 12, "t" * dice.randrange(1, 9), round(dice.random(), 3), dice.choice(["gray", "binary"])))
    want = []
    for page in (0, 1):
        kept = []
        for b in sorted((b for b in blocks if b[1] == page), key=lambda b: (-b[8], -len(b[7]))):
            hit = next((k for k in kept if iou(b[3:7], k[:4]) > 0.5), None)
            if hit is None:
                kept.append([*b[3:7], *b[7:]])
            elif len(b[7]) > len(hit[4]) or b[8] > hit[5]:
                hit[4:] = b[7:]
        want += [(page, *k) for k in kept]
    got = P.fuse_blocks(spark.createDataFrame(blocks, SCHEMA), first_box=True).select("page", "x1", "y1", "x2", "y2", "text", "confidence", "pass_label")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) < len(blocks)


def test_cells_merge_consecutive_texts(spark):
    texts = [("a", 0.5), (" a ", 0.9), ("b", 0.1), ("", 1.0), ("a", 0.3), ("a", 0.2)]
    blocks = [("d", 1, k, 10.0 + k, 10.0 + k / 10, 30.0 + k, 20.0, t, c, "g") for k, (t, c) in enumerate(texts)] + [("d", 1, 9, 300.0, 10.0, 320.0, 20.0, "z", 0.4, "g")]
    got = P.grid_cells(spark.createDataFrame(blocks, SCHEMA)).select("row_no", "col_no", "text", "parts", "confidence").collect()
    assert sorted(map(tuple, got)) == [(0, 0, "a b a", 3, 0.9), (0, 1, "z", 1, 0.4)]
