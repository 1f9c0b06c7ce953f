"""Every query of this package, with the pipeline at the repository top."""

from chaintrail.llm import byte_bpe, collocations, decontaminate, fingerprints, importance, language_id, minhash_dedup, pii, token_files, toxicity, url_filter, vector_dedup, warc_dedup  # noqa: F401
from chaintrail.llm.registry import QUERIES  # noqa: F401

import corpus_pipeline  # noqa: E402, F401  isort:skip
