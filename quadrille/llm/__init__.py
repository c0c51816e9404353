"""Operations for preparing language-model training data.

Nothing outside this folder (besides the top-level ``corpus_pipeline``) imports it.
"""
