"""From grammar text to what runs: syntax tree, checks, regular expressions, and the matcher for what they cannot do."""
