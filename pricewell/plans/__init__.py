"""Small building blocks shared by the operators: session, sizing, retraining."""
