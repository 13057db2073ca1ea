"""Column-level building blocks (all JVM-side expressions, no Python UDFs)."""

from ledeframe.functions.text import (  # noqa: F401
    clean_alnum,
    clean_headline,
    join_words,
    split_words,
    strip_text,
    tokenizer_normalize,
    tokenizer_words,
)
from ledeframe.functions.sequence import (  # noqa: F401
    argmax_class,
    attention_mask,
    frame_sequence,
    pad_sequence,
    truncate_sequence,
)
from ledeframe.functions.rand import seeded_bits, seeded_uniform  # noqa: F401
from ledeframe.functions.mathfn import (  # noqa: F401
    clip_norm,
    clip_norm_global,
    sigmoid,
    softmax_array,
    total_steps,
    total_steps_accumulated,
    warmup_steps,
)
