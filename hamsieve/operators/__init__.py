"""DataFrame operators: mail decoding, gates, corpus, features, models, metrics, explanation."""
