"""Operations of a training-data pipeline, as a subpackage that nothing else imports."""
