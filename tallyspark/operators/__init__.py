"""DataFrame-to-DataFrame transformations over all users at once."""
