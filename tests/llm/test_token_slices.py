"""op7: the size of the slices that are encoded together changes no id."""

import inspect

from bindwell.llm import queries, tokenbin
from tests.llm.test_operators import WORDS, letters, table


def test_slices_change_no_id(spark):
    import random

    rng = random.Random(24)
    docs = table(spark, [letters(rng, rng.randrange(1, 60)) for _ in range(40)] + ["", None])
    digests = [sorted(map(tuple, tokenbin.token_file_digest(docs, WORDS, slice_bytes=size).collect())) for size in (50, 6 << 20)]
    assert digests[0] == digests[1] and len(digests[0]) == 42
    assert "slice_bytes=6 << 20" in inspect.getsource(queries.op7_token_planes)
