"""Text, HTML and summary files of a run."""
