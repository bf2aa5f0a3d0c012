import numpy as np
import pytest

VECTORS = "index_name string, vec_id long, embedding array<float>, side string, unit long, cells int"
HEADER = "index_name string, dimensions long, model string"


@pytest.fixture(scope="session")
def vector_tables(spark):
    """Builds (entries, responses, header) from {index: (width, [(id, vector or None)], [(id, vector)])}; columns that operators use inside clash on purpose."""

    def build(content):
        def rows(k):
            return spark.createDataFrame([(n, i, None if v is None else [None if x is None else float(x) for x in v], "x", 0, 0) for n, c in content.items() for i, v in c[k]], VECTORS)

        return rows(1), rows(2), spark.createDataFrame([(n, c[0], None) for n, c in content.items()], HEADER)

    return build


def clustered(rng, groups, each, width, spread):
    centres = rng.standard_normal((groups, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    out = np.repeat(centres, each, axis=0) + spread * rng.standard_normal((groups * each, width))
    return out.astype(np.float32)
