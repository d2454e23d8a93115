"""Analytics on scored trials: tables of trials with a confidence score and an error label."""
