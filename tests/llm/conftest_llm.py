"""Rows shared by the tests."""
#: Awkward rows: nulls, blanks, ties, repeated rows, a null id, very long text, marks and non-Latin text.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (4, "a"), (4, "b"), (None, "no id here"), (None, None),
       (5, "x " * 30_000), (6, "ünï çödé 漢字かな " * 40), (7, "one two three four five. " * 30), (8, "<|x|>   \x1c \U0001F600"), (2**62, "far away id")]
