"""Packaged learners: classifier, recommender, mixture, crowd labels."""
