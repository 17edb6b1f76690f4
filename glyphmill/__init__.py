"""glyphmill: text corpora to vocabularies, token tables and chat prompts, as Spark jobs."""
