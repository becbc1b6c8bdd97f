"""Operations on text and vector corpora for training data; nothing else in the package uses them."""
