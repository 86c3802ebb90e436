"""textguard: screening of prompts, agent traffic and document corpora on Spark."""
