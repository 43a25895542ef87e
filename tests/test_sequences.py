"""Operators over numbered rows against the reference's own examples."""

from quireflow.operators.sequences import islands, largest_gap


def test_gap_cuts_only_sequences_that_start_low(spark):
    pages = {1: [1, 2, 15, 16], 2: [5, 6, 15], 3: [3, 3, 9, 9, 15], 4: [4, 9], 5: [1, 4, 7], 6: [2], 7: [2, 2, 9, 9]}
    frame = spark.createDataFrame([(p, n) for p, numbers in pages.items() for n in numbers], "page int, n int")
    got = {p: [] for p in pages}
    for x in largest_gap(frame, "page", "n", 3, 3).collect():
        got[x.page].append(x.n)
    assert {p: sorted(n) for p, n in got.items()} == {1: [15, 16], 2: [5, 6, 15], 3: [9, 9, 15], 4: [4, 9], 5: [1, 4, 7], 6: [2], 7: [9, 9]}


def test_long_range_lists_are_cut(spark):
    pages = {1: [1, 2, 3, 5], 2: list(range(2, 200, 2)), 3: [*range(1, 40, 2), *range(50, 65, 2), *range(71, 81, 3)]}
    frame = spark.createDataFrame([(p, n) for p, numbers in pages.items() for n in numbers], "page int, n int")
    got = {x.page: x.ranges for x in islands(frame, "page", "n").collect()}
    whole = {p: ", ".join(map(str, numbers)) for p, numbers in pages.items()} | {1: "1-3, 5"}
    assert got == {p: t[:97] + "..." if len(t) > 100 else t for p, t in whole.items()}
    assert len(got[2]) == 100
