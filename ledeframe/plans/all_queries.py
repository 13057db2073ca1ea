"""Import every module that registers queries."""

from ledeframe.plans import slice  # noqa: F401
from ledeframe.plans import q_rows  # noqa: F401
from ledeframe.plans import q_encode  # noqa: F401
from ledeframe.plans import q_random  # noqa: F401
from ledeframe.plans import q_metrics  # noqa: F401
from ledeframe.plans import q_runlog  # noqa: F401
from ledeframe.plans import q_vectors  # noqa: F401
from ledeframe.plans import q_train, q_training, q_options  # noqa: F401
