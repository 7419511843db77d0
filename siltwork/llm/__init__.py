"""Operators for preparing language-model training corpora; nothing else in siltwork imports this subpackage."""
