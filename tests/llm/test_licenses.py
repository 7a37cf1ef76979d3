import random

from marlstone.llm import licenses as L


def test_every_template_is_found_anywhere():
    scanner, r = L.Scanner(L.TEMPLATES), random.Random(3)
    for name, text in L.TEMPLATES.items():
        noise = [" ".join(r.choice("alpha beta gamma the of license under") for _ in range(r.randint(0, 200))) for _ in range(2)]
        found = scanner.scan(f"{noise[0]} {text} {noise[1]}")
        assert name in [f[0] for f in found]
        at = next(f for f in found if f[0] == name)
        assert at[1] == 1.0 and at[2] == len(L.words_of(noise[0]))


def naive(scanner, text):
    """Every window of every template compared with it; places dropped one by one."""
    h = L.shingle_hashes(L.words_of(text))
    places = set()
    for name, s in scanner.sets.items():
        m, step = len(s), max(1, len(s) // L.STEPS)
        for start in range(0, max(1, len(h)), step):
            lo = max(0, start - m // 4)
            wide = h[lo : start + m + m // 4].tolist()
            held = [k for k, x in enumerate(wide) if x in set(s.tolist())]
            share = len({wide[k] for k in held}) / m
            # A window without any shingle of the template is no window of its text.
            if share >= scanner.least and set(h[start : start + m].tolist()) & set(s.tolist()):
                places.add((share, lo + held[0], lo + held[-1] + L.SHINGLE - 1, name))
    stand = []
    for p in sorted(places, key=lambda p: (-p[0], *p[1:])):
        if not any(q[0] > p[0] and q[1] <= p[2] and p[1] <= q[2] for q in stand):
            stand.append(p)
    return {name: next(p[0] for p in stand if p[3] == name) for _, _, _, name in stand}


def test_damaged_and_mixed_notices_against_brute_force():
    scanner, r = L.Scanner(L.TEMPLATES), random.Random(5)
    names = list(L.TEMPLATES)
    for _ in range(60):
        text = []
        for name in r.choices(names, k=r.randint(1, 3)):
            w = L.words_of(L.TEMPLATES[name])
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                w[r.randrange(len(w))] = "changed"
            text += [r.choice("alpha beta the of")] * r.randint(0, 30) + w
        text = " ".join(text)
        # Bands may retrieve less than the brute force compares only where the two sets are unlike, far under the least share.
        assert {f[0]: f[1] for f in scanner.scan(text)} == naive(scanner, text)


def test_only_a_place_that_stands_drops_another():
    places = {(0.88, 0, 10, "a"), (0.89, 8, 20, "b"), (1.0, 18, 30, "c"), (0.8, 5, 6, "a")}
    assert [x[:2] for x in L.standing(places)] == [("a", 0.88), ("c", 1.0)]
    # A damaged notice elsewhere is not hidden by a fuller version at the first place.
    places = {(1.0, 0, 10, "v3"), (0.875, 0, 10, "v2"), (0.875, 50, 60, "v2")}
    assert L.standing(places) == [("v2", 0.875, 50, 60), ("v3", 1.0, 0, 10)]


def test_versions_of_a_notice_are_told_apart():
    found = [f[0] for f in L.Scanner(L.TEMPLATES).scan("This work is licensed under the GNU General Public License, version 3.")]
    assert found == ["gpl-3.0-notice"]


def test_band_settings():
    assert L.miss_probability(0.8) < 1e-6 and L.miss_probability(1.0) < 1e-19


def test_table_edge_cases(spark):
    mit = "Released under the MIT License."
    df = spark.createDataFrame([(1, mit, "k"), (1, mit, "k"), (None, mit, "k"), (2, None, "k"), (3, "", "k"), (4, "word " * 200_000 + mit, "k")], "doc_id long, text string, license_id string")
    got = sorted((r.doc_id or 0, r.license_id, r.containment) for r in L.scan_licenses(df).collect())
    assert got == [(i, "mit-notice", 1.0) for i in (0, 1, 1, 4)]
    assert L.scan_licenses(df.limit(0)).count() == 0
