"""The canonical function vocabulary and its dialects."""
