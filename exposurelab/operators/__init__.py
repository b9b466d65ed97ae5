"""DataFrame operators: matching, exploration, text and estimation."""
