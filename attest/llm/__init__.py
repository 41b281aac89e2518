"""Operators for preparing training data: mixing, language, near copies, media, secrets, packing, archives, tokens, fingerprints, licences."""
