"""Survivors of the near-duplicate stage where ids are null or shared by unrelated texts."""

from test_near_duplicates import kept, words


def test_components_that_share_an_id_or_have_none_all_survive(spark):
    one, two, three, four, five = (" ".join(words(name, 60)) for name in "abcde")
    near = " ".join([*words("b", 58), "x", "y"])
    rows = [
        (None, one), (None, two), (None, near), (None, three), (None, three),  # unrelated texts without ids
        (7, four), (7, five), (8, five), (7, "  "), (9, one + " z"),
    ]
    got = kept(spark, rows)
    texts = [t for _, t in got]
    assert len(got) == 6 and (9, one + " z") in got and one not in texts
    assert (two in texts) != (near in texts) and texts.count(three) == 1
    assert (7, four) in got and (7, five) in got and (7, "  ") in got
