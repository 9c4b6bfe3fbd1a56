"""quillspark: DataFrame-native text normalization, review and scoring for very large corpora."""
